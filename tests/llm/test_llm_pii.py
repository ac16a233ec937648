import re
from datetime import date

import pytest

from keyfold.llm.pii import pseudonymise

SCHEMA = "doc_id bigint, text string, _x int, n int, found string"


def luhn(s):
    t = 0
    for i, d in enumerate(reversed(re.sub(r"\D", "", s))):
        d = int(d) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, 0, 1, "f") for i, t in enumerate(texts)], SCHEMA)
    out = pseudonymise(df, key, changed_col="changed")
    assert out.columns == [*df.columns, "changed"]
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["changed"] for r in rows]


FORMS = {
    "und.34@mail7.example.com": r"[a-z]{3}\.\d\d@mail7\.example\.com",
    "4111111111111111": r"\d{16}", "4111-1111-1111-1111": r"\d{4}-\d{4}-\d{4}-\d{4}", "378282246310005": r"\d{15}",
    "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}", "233.254.104.120": r"\d{1,3}(\.\d{1,3}){3}",
    "2024-02-29": r"\d{4}-\d\d-\d\d", "02/29/2024": r"\d\d/\d\d/\d{4}", "29.02.2024": r"\d\d\.\d\d\.\d{4}",
    "123-45-6789": r"\d{3}-\d\d-\d{4}", "DE89370400440532013000": r"DE\d{20}", "GB82 WEST 1234 5698 7654 32": r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d",
}


def test_formats_stay_and_values_go(spark):
    texts, changed = run(spark, [f"a {v}, b" for v in FORMS])
    for (value, form), text, n in zip(FORMS.items(), texts, changed):
        new = text[2:-3]
        assert re.fullmatch(form, new) and new != value and n == 1, (value, text)


MORE_FORMS = {
    "1990-01-02": r"\d{4}-\d\d-\d\d", "25/12/1999": r"\d\d/\d\d/\d{4}", "1999/12/25": r"\d{4}/\d\d/\d\d",
    "3/4/2020": r"\d\d?/\d\d?/\d{4}", "25/1/2020": r"\d\d?/\d\d?/\d{4}", "3.4.2020": r"\d\d?\.\d\d?\.\d{4}", "2020-3-4": r"\d{4}-\d\d?-\d\d?",
    "+33 1 23 45 67 89": r"\+\d\d \d( \d\d){4}", "+44 (0)20 7946 0958": r"\+\d\d \(\d\)\d\d \d{4} \d{4}", "01 23 45 67 89": r"\d\d( \d\d){4}",
    "020 7946 0958": r"\d{3} \d{4} \d{4}", "07700 900123": r"\d{5} \d{6}", "5551234567": r"\d{10}",
}


def test_values_between_commas_and_in_further_spellings_go(spark):
    frames = ["Smith,{},12", "x,{}", "{},12", "12,{},7", "see {}."]
    texts, changed = run(spark, [f.format(v) for v in MORE_FORMS for f in frames])
    cases = [(v, form, f) for v, form in MORE_FORMS.items() for f in frames]
    for (value, form, frame), text, n in zip(cases, texts, changed):
        head, tail = frame.split("{}")
        assert text.startswith(head) and text.endswith(tail) and n == 1, (value, text)
        new = text[len(head) : len(text) - len(tail)]
        assert re.fullmatch(form, new) and new != value, (value, text)


def test_spellings_of_one_date_stay_linked_and_other_numbers_stay(spark):
    (iso, slash, day, dot), _ = run(spark, ["1999-12-25", "1999/12/25", "25/12/1999", "25.12.1999"])
    y, m, d = iso.split("-")
    assert (slash, day, dot) == (f"{y}/{m}/{d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}")
    (span,), changed = run(spark, ["1999-12-25/2000-01-02"])
    assert span.split("/")[0] == iso and changed == [2]
    texts = ["31.12.2020.1", "1.2.3.2020", "32/13/2020", "0 0 0 0 0 0 0 0 0 0", "00 00 00 00 00", "0.5551234567", "1700000000", "5551234567.25"]
    assert run(spark, texts) == (texts, [0] * len(texts))


def test_results_are_valid_again(spark):
    cards = ["4111111111111111", "5500005555555559", "9807915762804490"]
    cards = [c for c in cards if luhn(c)]
    assert len(cards) >= 2
    (text,), _ = run(spark, [" ".join(cards)])
    assert all(luhn(c) and len(c) == 16 for c in text.split())
    (iban, ip, day), _ = run(spark, ["GB82WEST12345698765432", "255.255.0.1", "1999-12-31"])
    spelled = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(spelled) % 97 == 1
    assert all(int(o) <= 255 for o in ip.split("."))
    assert date(1900, 1, 1) <= date.fromisoformat(day) <= date(2099, 11, 12)


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112", "999.1.1.1", "2023-02-29", "13/13/2020", "000-12-3456", "DE88370400440532013000", "CC BY-NC 4.0.", "1.2.3.4.5", "0000000000000000", "a@b", "12 34 56"]
    assert run(spark, texts) == (texts, [0] * len(texts))


def test_equal_values_stay_linked_across_formats_and_documents(spark):
    (a, b, c), _ = run(spark, ["x +1 (017) 555-7713 y", "017-555-7713 4111 1111 1111 1111", "(017) 555-7713, 4111111111111111"])
    digits = [re.sub(r"\D", "", t) for t in (a, b, c)]
    assert digits[0][1:] == digits[1][:10] == digits[2][:10] and digits[1][10:] == digits[2][10:]
    (iso, us, dot), _ = run(spark, ["2001-05-09", "05/09/2001", "09.05.2001"])
    y, m, d = iso.split("-")
    assert us == f"{m}/{d}/{y}" and dot == f"{d}.{m}.{y}"


def test_one_to_one_and_keyed(spark):
    ips = [f"10.{i}.{j}.7" for i in range(16) for j in range(16)]
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    one, _ = run(spark, [" ".join(ips), " ".join(days)])
    assert len(set(one[0].split())) == len(ips) and len(set(one[1].split())) == len(days)
    two, _ = run(spark, [" ".join(ips), " ".join(days)], key="other")
    assert two != one and run(spark, [" ".join(ips), " ".join(days)])[0] == one


def test_null_empty_repeated_long_and_empty_table(spark):
    long = "word " * 50000 + "und.34@mail7.example.com"
    texts, changed = run(spark, [None, "", "no", "1.1.1.1", "1.1.1.1", long])
    assert texts[:3] == [None, "", "no"] and texts[3] == texts[4] and changed == [0, 0, 0, 1, 1, 1]
    assert texts[5].startswith("word ") and "und.34" not in texts[5]
    assert pseudonymise(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_plan_is_native(spark):
    df = pseudonymise(spark.createDataFrame([(1, "a", 0, 1, "f")], SCHEMA), "k")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_as_the_operator_names_its_own(spark):
    df = spark.createDataFrame([(1, "write to a@b.com", 7, 8, 9, 10)], "doc_id long, text string, _found int, _Between int, _fresh int, x int")
    out = pseudonymise(df, "key")
    assert out.columns == df.columns
    row = out.first()
    assert tuple(row)[2:] == (7, 8, 9, 10) and row["text"] != "write to a@b.com" and row["text"].startswith("write to ")
