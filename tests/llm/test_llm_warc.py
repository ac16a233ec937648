import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from keyfold.llm import zip_warc as Z
from keyfold.llm.common import open_store

SCHEMA = "page_id bigint, url string, html string, digest string, n int, first int, path string"


def pages():
    long = "<p>é" + "x" * 200
    base = [(5, "http://a/ b\r\nX: 1", long), (3, "http://b", long), (9, None, long), (3, "again", long), (1, "s", "short"), (2, "s", "short"), (7, "n", None), (8, "e", ""), (None, "u", long), (None, "only", "y" * 150), (None, "only", "y" * 150), (11, "big", "z" * 3_000_000)]
    return [(*r, "d", 1, 2, "p") for r in base]


def expected(rows):
    out = []
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        refers = first.get(h) if first.get(h) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("package_bytes", [Z.PACKAGE_BYTES, 1])
def test_round_trip(spark, package_bytes):
    rows = pages()
    manifest = Z.write(spark.createDataFrame(rows, SCHEMA).repartition(2), package_bytes=package_bytes)
    got = Z.read(spark, manifest).collect()
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[k] for k in keys) for r in got), key=repr) == expected(rows)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None
    if package_bytes == 1:
        assert manifest.count() == len(rows)
    store, at = open_store(manifest.first()["path"])
    with store.open_input_file(at) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_empty_table(spark):
    assert Z.read(spark, Z.write(spark.createDataFrame([], SCHEMA))).count() == 0


class Counted(io.BytesIO):
    """A file that notes how much of it was read."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        self.taken += n
        return self.getvalue()[at : at + n]


def packed(comment=b"", names=2):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(names):
            z.writestr(f"m{i}", f"content {i}" * 10)
        z.comment = comment
    return out.getvalue()


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = packed(names=5)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    p = Z.Package(Counted(data))
    assert [p.read(f"m{i}") for i in range(5)] == [f"content {i}".encode() * 10 for i in range(5)]


def test_end_record_behind_a_comment_that_holds_its_mark():
    p = Z.Package(Counted(packed(b"x PK\x05\x06 and eighteen more bytes of it")))
    assert p.read("m1") == b"content 1" * 10


def test_reads_ranges_only():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("big", b"\0" * 5_000_000)
        z.writestr("small", b"s")
    f = Counted(out.getvalue())
    assert Z.Package(f).read("small") == b"s" and f.taken < 100_000


def test_compressed_members_and_damage_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        Z.Package(Counted(out.getvalue())).read("a")
    with pytest.raises(ValueError):
        Z.Package(Counted(b"not a zip"))
    member = Z.record(1, "u", b"payload", "0" * 64, None)
    with pytest.raises(ValueError, match="damaged"):
        Z.parse_record(member)
