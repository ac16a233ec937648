"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents.  All but the last
return the columns of ``documents``:

1. quality: documents that the factorisation machine rejects go;
2. exact_dedup: of equal texts the smallest id stays;
3. ngram_join: of each group of near duplicates the smallest id stays, and
   rows that share an id go or stay by their own texts;
4. mixing: documents as often, and as far, as their source's target takes them;
5. packing: pieces of documents in sequences of at most 2048 tokens.

Rows without a text count as empty documents, rows without an id are kept
apart from each other, an empty table gives an empty result, and further
columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import exact_dedup, mixing, ngram_join, packing, quality
from keyfold.llm.catalogue import QUALITY_THRESHOLD, vocabulary
from keyfold.llm.common import materialise, small, table

#: Pieces that a packing worker of the pipeline remembers: its executors hold
#: what the stages before have left.
PIECES = 600_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.kept(docs, model, QUALITY_THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = ngram_join.classes(docs, mark_col="mark").where("id <> component").select("id", "mark")
    gone = small(materialise(dropped, "near-copies"))
    return docs.join(gone, (docs["doc_id"] == gone["id"]) & (ngram_join.mark(docs["text"]) == gone["mark"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), pieces=PIECES)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the random mix have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
