import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCS

from keyfold.llm import quality as Q
from keyfold.llm.common import table, utf8

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return Q.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    scores = {r["id"]: r["score"] for r in Q.scored(table(spark, SF, "documents"), model).collect()}
    held = [r for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(scores[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in held]
    assert len(held) > 50 and np.mean(right) >= 0.93
    assert np.mean([scores[r["doc_id"]] >= 0.3 for r in held if r["quality"] == 1]) >= 0.98


def test_sum_of_squares_is_the_sum_over_pairs(model):
    body, at = utf8(pa.array(["one two two, THREE!! four", ""]))
    f = Q.features(body, at, np.array([25.0, 0.0]))
    begin, index, value, doc = model._full(f)
    for row in (0, 1):
        i, x = index[doc == row], value[doc == row]
        pairs = sum(float(model.factors[a] @ model.factors[b]) * u * v for (a, u), (b, v) in itertools.combinations(list(zip(i, x)), 2))
        margin = model.bias + float(model.linear[i] @ x) + pairs
        assert np.isclose(model.score(f)[row], 1 / (1 + np.exp(-margin)), atol=1e-4)


def test_reruns_agree_and_layout_does_not_matter(spark, model):
    again = Q.train(table(spark, SF, "documents").repartition(5), table(spark, SF, "labels").repartition(3))
    assert np.array_equal(again.linear, model.linear) and again.bias == model.bias


def test_edge_rows(spark, model):
    rows = [(1, None, "en", "s", None), (None, "", "en", "s", 0), (2, "x " * 200000, "en", None, 400000), (2, "x", None, "s", -5), (3, " \n", "e", "s", 2)]
    df = spark.createDataFrame(rows, DOCS)
    got = Q.scored(df, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"] or abs(got[0]["score"] - got[1]["score"]) < 1e-6
    kept = Q.kept(df, model, 0.0)
    assert kept.columns == df.columns and kept.count() == 5
    assert Q.kept(df, model, 1.1).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert Q.scored(empty, model).count() == 0


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    none = Q.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int"))
    assert Q.scored(docs, none).first()["score"] == 0.5
