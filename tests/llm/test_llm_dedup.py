import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyfold.llm import exact_dedup as X

SCHEMA = "doc_id bigint, text string, digest int, id string, n int, stays string, at int"


def rows():
    texts = ["a b", "a  b", "a\tb", " a b", None, "", "x", "a b", "X", "long " * 4000, "long  " * 4000, "x"]
    ids = [7, 3, 9, 4, 5, 6, None, 3, 1, 2, 8, 11]
    return [(i, t, 0, "z", 1, "s", 2) for i, t in zip(ids, texts)]


def brute(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def table(spark, tmp_path, data, parts=3):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.parquet(path)
    return path


@pytest.mark.parametrize("options", [{}, {"files_per_batch": 1}, {"salt_rows": 1}])
def test_equals_brute_force(spark, tmp_path, options):
    data = rows()
    got = X.decide(spark, table(spark, tmp_path, data), **options).collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got), key=repr) == brute(data)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["digest"] for r in got})  # one row of each group, ties included
    assert all(r["id"] == r["keep_id"] for r in kept)


def test_colliding_digests_are_told_apart_by_their_bytes(spark, tmp_path):
    data = rows()
    path = table(spark, tmp_path, data)
    weak = X.decide(spark, path, digest=lambda t: F.length(t).cast("string")).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"]) for r in weak if r["id"]) == sorted(r[:3] for r in brute(data) if r[0])


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    data = rows()
    path, held = str(tmp_path / "grow.parquet"), str(tmp_path / "state")
    spark.createDataFrame(data[:6], SCHEMA).coalesce(1).write.parquet(path)
    X.run_state(spark, path, checkpoint=held)
    spark.createDataFrame(data[6:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    state = X.run_state(spark, path, checkpoint=held).collect()
    expect = {(r[1], r[2], r[3]) for r in brute(data)}
    assert {(r["stays"]["id"], r["n"], r["digest"]) for r in state} == expect


def test_empty_table_and_columns_kept(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.dedup_table(empty).count() == 0
    out = X.dedup_table(spark.createDataFrame(rows(), SCHEMA))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert out.count() == len({r[3] for r in brute(rows())})


def test_a_column_named_like_the_file_metadata(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None)], "doc_id long, text string")
    docs = docs.withColumn("_metadata", F.lit("theirs")).withColumn("file", F.lit("f"))
    kept = X.dedup_table(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_metadata"], r.file) for r in kept.collect()) == [(1, "theirs", "f"), (3, "theirs", "f")]
