"""The pipeline and the registered queries against plain versions."""

import re
import sys

import numpy as np
import pytest
from llm_helpers import WORD, near_classes
from test_llm_packing import check

import __spark_entry__ as E
import corpus_pipeline as C
from keyfold.llm import mixing, quality
from keyfold.llm.catalogue import ORACLES, QUERIES
from keyfold.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted({int(n.split("_")[0][2:]) for n in QUERIES}) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= E.queries().keys() and ORACLES.keys() <= E.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[1]))
    from oracle_check import compare

    assert compare(spark, SF, [name])[name].startswith("OK")


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stages = dict(C.STAGES)

    def run(name):
        nonlocal docs
        before = docs.toPandas()
        docs = materialise(stages[name](spark, docs, SF), "t")
        return before, docs.toPandas()

    before, after = run("quality")
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {r["id"]: r["score"] for r in quality.scored(table(spark, SF, "documents"), model).collect()}
    assert set(after.doc_id) == {i for i in before.doc_id if scores[i] >= 0.3}
    assert docs.columns == table(spark, SF, "documents").columns

    before, after = run("exact_dedup")
    norm = before.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
    assert sorted(after.doc_id) == sorted(before.groupby(norm).doc_id.min())

    before, after = run("ngram_join")
    near = near_classes(dict(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted(set(near.values()))

    mixed = mixing.mix(docs).toPandas()
    before, after = run("mixing")
    size = lambda t: len(WORD.findall(t))
    want = {i: n for i, n in zip(mixed.id, mixed.taken) if n}
    assert after.text.map(size).groupby(after.doc_id).sum().to_dict() == want
    total = before.text.map(size).groupby(before.source).sum().sort_index()
    goal = dict(zip(total.index, mixing.targets(total.tolist())))
    got = after.text.map(size).groupby(after.source).sum()
    assert all(abs(got.get(s, 0) - g) <= 2 * mixing.BLOCK for s, g in goal.items())

    before, after = run("packing")
    again = before.assign(n=np.arange(len(before)))
    check([(r.doc_id, r.text) for r in again.itertuples()], after.to_dict("records"))


def test_run_and_empty_table(spark, tmp_path):
    assert C.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = table(spark, SF, "documents")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
