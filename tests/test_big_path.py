"""Every registered batch query gives the same rows whatever the number of
ranges its ordered passes are cut into."""

from conftest import SF01
from oracle_check import canon

from keyfold.plans.catalogue import QUERIES


def test_layout_does_not_matter(spark):
    names = [n for n in QUERIES if not n.startswith("stream_")]
    first = {n: canon(QUERIES[n](spark, SF01).toPandas()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # several ranges per key
    try:
        diff = [n for n in names if canon(QUERIES[n](spark, SF01).toPandas()) != first[n]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert diff == []
