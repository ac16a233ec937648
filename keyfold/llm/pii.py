"""Format-preserving pseudonyms for personal data, in SQL functions only.

Patterns find candidates; each is validated (Luhn digit, octets up to 255,
calendar dates, IBAN remainder, number plans' lengths) and then mapped by a
keyed Feistel permutation within its own format: a card number becomes another
card number with a right check digit, a date another date written the same
way.  The permutation depends only on the key, the kind and the value without
its separators, so equal values stay linked across documents, however written,
and different values of a kind stay different.  What fails validation stays.

kinds: ``email`` (letters and digits of the local part), ``ip``, ``phone``
(the national number), ``card`` (13 to 19 digits), ``ssn``, ``iban`` (account
part), ``date`` (yyyy-mm-dd, yyyy/mm/dd, mm/dd/yyyy, dd/mm/yyyy, dd.mm.yyyy,
also without leading zeros, within its span of 73000 days, 1900-01-01 to
2099-11-12).  A date of two numbers and a year with slashes has its month
first, unless the first number is above 12; where a text mixes both orders,
two different days may come out as the same signs.

The Feistel network: the value is a list of small numbers with their moduli
(10 for a digit, 26 for a letter, 256 for an octet).  The list is cut in two;
in each of 8 rounds the left half is shifted, each number within its modulus,
by SHA-256 of key, kind, round and right half, and the halves change sides.

Defined cases: a null text stays null, an empty one empty; repeated rows give
equal results; texts of any length are read whole, and only those with an
``@`` or digits in a row reach the patterns; extra columns pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import free_name

ROUNDS = 8
EPOCH, DAYS_HIGH, DAYS_LOW = "1900-01-01", 250, 292

#: The patterns of the kinds, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?:(?<![0-9][.-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9]|[.-][0-9])"
    r"|(?<![0-9][./])(?:[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./][0-9])"
    r"|(?<![0-9]\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9]))",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?: ?\([0-9]{1,4}\)|[ .-][0-9](?=[ .-]))?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    # national numbers: ten or eleven digits behind a trunk 0, or ten digits without separators
    r"|(?<![0-9+(])(?<![0-9][.-])(?=\(?0(?:[ ).-]{0,2}[0-9]){9,10}(?![0-9]))\(?0[1-9][0-9]{0,3}\)?(?:(?:[ .-][0-9]{2,4}){2,4}|[ .-][0-9]{5,8})(?![0-9]|[.-][0-9])"
    r"|(?<![0-9+])(?<![0-9][.-])(?:0[1-9][0-9]{8,9}|[2-9][0-9]{9})(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def permuted(values: str, moduli: str, key: str, kind: str) -> str:
    """SQL: the list ``values`` (ints below ``moduli``) permuted under the key."""
    shift = (
        "conv(substr(sha2(concat_ws(':', " + _lit(key) + ", " + _lit(kind) + ", string(i), string(j div 16), "
        "array_join(transform(s.b, y -> string(y)), '.')), 256), 1 + (j % 16) * 4, 4), 16, 10)"
    )
    half = "int(size(v) / 2)"
    start = (
        f"struct(slice(v, 1, {half}) AS a, slice(m, 1, {half}) AS ma, "
        f"slice(v, {half} + 1, size(v)) AS b, slice(m, {half} + 1, size(v)) AS mb)"
    )
    step = f"struct(s.b AS a, s.mb AS ma, transform(s.a, (x, j) -> int((x + {shift}) % s.ma[j])) AS b, s.ma AS mb)"
    run = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}, s -> concat(s.a, s.b))"
    return _let("v", values, _let("m", moduli, run))


def _digits(text: str) -> str:
    return f"transform(filter(split({text}, ''), c -> c <> ''), c -> int(c))"


def _tens(text: str) -> str:
    return f"array_repeat(10, length({text}))"


def _refill(text: str, fresh: str, sign: str = "[0-9]") -> str:
    """``text`` with its signs replaced in order by the characters of ``fresh``."""
    spare = sign.replace("[", "[^")
    at = f"length(regexp_replace(substr({text}, 1, k + 1), {_lit(spare)}, ''))"
    return (
        f"array_join(transform(filter(split({text}, ''), c -> c <> ''), "
        f"(c, k) -> CASE WHEN c rlike {_lit(sign)} THEN substr({fresh}, {at}, 1) ELSE c END), '')"
    )


def _luhn_sum(digits: str, doubled: int) -> str:
    """Luhn sum of a digit list; ``doubled``: parity, from the right, of the
    places that are doubled."""
    return (
        f"aggregate(transform(reverse({digits}), (d, k) -> CASE WHEN k % 2 = {doubled} THEN d * 2 - 9 * int(d > 4) ELSE d END), "
        "0, (t, d) -> t + d)"
    )


def _only(text: str, spare: str = "[^0-9]") -> str:
    return f"regexp_replace({text}, {_lit(spare)}, '')"


def _string(values: str) -> str:
    return f"array_join(transform({values}, d -> string(d)), '')"


def _card(x: str, key: str) -> str:
    front = _let("f", "substr(n, 1, length(n) - 1)", permuted(_digits("f"), _tens("f"), key, "card"))
    fresh = _let("p", front, f"concat({_string('p')}, string((10 - {_luhn_sum('p', 0)} % 10) % 10))")
    valid = f"length(n) BETWEEN 13 AND 19 AND {_luhn_sum(_digits('n'), 1)} % 10 = 0 AND n rlike '[1-9]'"
    return _let("n", _only(x), f"CASE WHEN {valid} THEN {_let('r', fresh, _refill(x, 'r'))} ELSE {x} END")


def _tail(x: str, key: str, kind: str, length: int) -> str:
    """The last ``length`` digits permuted, those before them as they are."""
    cut = f"substr(n, length(n) - {length - 1}, {length})"
    fresh = _let("f", cut, f"concat(substr(n, 1, length(n) - {length}), {_string(permuted(_digits('f'), _tens('f'), key, kind))})")
    return _let("n", _only(x), _let("r", fresh, _refill(x, "r")))


def _phone(x: str, key: str) -> str:
    whole = _let("n", _only(x), _let("r", f"concat(substr(n, 1, 1), {_let('f', 'substr(n, 2)', _string(permuted(_digits('f'), _tens('f'), key, 'phone-short')))})", _refill(x, "r")))
    return f"CASE WHEN length({_only(x)}) BETWEEN 10 AND 15 THEN {_tail(x, key, 'phone', 10)} WHEN length({_only(x)}) >= 7 AND length({_only(x)}) < 10 THEN {whole} ELSE {x} END"


def _ip(x: str, key: str) -> str:
    fresh = permuted("o", "array(256, 256, 256, 256)", key, "ip")
    return _let(
        "o", f"transform(split({x}, '[.]'), c -> int(c))",
        f"CASE WHEN forall(o, c -> c <= 255) THEN array_join(transform({fresh}, c -> string(c)), '.') ELSE {x} END",
    )


def _date(x: str, key: str) -> str:
    day_first = f"{x} rlike '^(?:1[3-9]|[2-9][0-9])/'"
    form = (
        f"CASE WHEN {x} rlike '-' THEN 'yyyy-MM-dd' WHEN {x} rlike '^[0-9]{{4}}/' THEN 'yyyy/MM/dd' "
        f"WHEN {day_first} THEN 'dd/MM/yyyy' WHEN {x} rlike '/' THEN 'MM/dd/yyyy' ELSE 'dd.MM.yyyy' END"
    )
    # without leading zeros
    form = f"CASE WHEN length({x}) = 10 THEN {form} ELSE replace(replace({form}, 'MM', 'M'), 'dd', 'd') END"
    days = f"datediff(try_to_timestamp({x}, g), DATE'{EPOCH}')"
    fresh = permuted(f"array(int(n div {DAYS_LOW}), int(n % {DAYS_LOW}))", f"array({DAYS_HIGH}, {DAYS_LOW})", key, "date")
    moved = _let("p", fresh, f"date_format(date_add(DATE'{EPOCH}', p[0] * {DAYS_LOW} + p[1]), g)")
    return _let("g", form, _let("n", days, f"CASE WHEN n BETWEEN 0 AND {DAYS_HIGH * DAYS_LOW - 1} THEN {moved} ELSE {x} END"))


def _signs(values_of: str, key: str, kind: str) -> str:
    """Letters and digits permuted within their class, other signs dropped."""
    kept = f"filter(split({values_of}, ''), c -> c rlike '[A-Za-z0-9]')"
    low = "CASE WHEN c rlike '[0-9]' THEN 48 WHEN c rlike '[A-Z]' THEN 65 ELSE 97 END"
    value = f"transform(e, c -> ascii(c) - {low})"
    moduli = "transform(e, c -> CASE WHEN c rlike '[0-9]' THEN 10 ELSE 26 END)"
    back = f"array_join(zip_with(e, p, (c, d) -> char({low} + d)), '')"
    return _let("e", kept, _let("p", permuted(value, moduli, key, kind), back))


def _email(x: str, key: str) -> str:
    local = f"substring_index({x}, '@', 1)"
    fresh = _let("r", _signs(local, key, "email"), _refill(local, "r", "[A-Za-z0-9]"))
    return f"concat({fresh}, '@', substring_index({x}, '@', -1))"


def _mod97(text: str) -> str:
    """The number that IBAN signs spell (A = 10 .. Z = 35), modulo 97."""
    return (
        f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (t, c) -> CASE WHEN c rlike '[0-9]' THEN (t * 10 + int(c)) % 97 "
        "ELSE (t * 100 + ascii(c) - 55) % 97 END)"
    )


def _iban(x: str, key: str) -> str:
    check = f"98 - {_mod97(chr(39).join(['concat(b, substr(n, 1, 2), ', '00', ')']))}"
    fresh = _let("b", _signs("substr(n, 5)", key, "iban"), f"concat(substr(n, 1, 2), lpad(string({check}), 2, '0'), b)")
    valid = f"{_mod97('concat(substr(n, 5), substr(n, 1, 4))')} = 1"
    return _let("n", _only(x, " "), f"CASE WHEN {valid} THEN {_let('r', fresh, _refill(x, 'r', '[A-Z0-9]'))} ELSE {x} END")


def pseudonym(x: str, key: str) -> str:
    """SQL: the pseudonym of one matched value ``x``, or ``x`` if it is not valid."""
    kinds = {
        "email": _email(x, key), "iban": _iban(x, key), "date": _date(x, key), "ip": _ip(x, key),
        "ssn": f"CASE WHEN {x} rlike '^(000|666|9)' OR {x} rlike '-00-|-0000$' THEN {x} ELSE {_tail(x, key, 'ssn', 9)} END",
        "phone": _phone(x, key), "card": _card(x, key),
    }
    # a run of digits that the phone pattern could claim may be a card number
    return "CASE " + " ".join(f"WHEN {x} rlike {_lit('^(?:' + PATTERNS[k] + ')$')} THEN {sql}" for k, sql in kinds.items()) + f" ELSE {x} END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str | None = None, changed_col: str | None = None) -> DataFrame:
    """``docs`` with the text's personal data replaced (into ``out_col``, else
    in place); ``changed_col``: how many values were replaced."""
    out_col = out_col or text_col
    text = F.col(text_col)
    hit = F.coalesce(text.rlike("@|[0-9][ ./()-]{0,2}[0-9]"), F.lit(False))
    none = F.array().cast("array<string>")
    # columns of our own that no column of the caller's is called
    taken = [*docs.columns, out_col, *([changed_col] if changed_col else [])]
    values, parts, fresh = (free_name(taken, f"_{name}") for name in ("found", "between", "fresh"))
    found = docs.withColumn(values, F.when(hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    # the text between the values: one part more than there are values
    between = F.when(F.size(values) > 0, F.split(text, ANY, -1))
    found = found.withColumn(parts, between).withColumn(
        fresh, F.when(F.size(values) > 0, F.expr(f"transform({values}, x -> {pseudonym('x', key)})")).otherwise(none)
    )
    woven = F.concat(F.col(parts)[0], F.expr(f"array_join(zip_with({fresh}, slice({parts}, 2, size({fresh})), (x, y) -> concat(x, y)), '')"))
    out = found.withColumn(out_col, F.when(F.size(values) > 0, woven).otherwise(text))
    if changed_col:
        out = out.withColumn(changed_col, F.expr(f"int(size(filter(zip_with({values}, {fresh}, (x, y) -> x <> y), z -> z)))"))
    return out.drop(values, parts, fresh)
