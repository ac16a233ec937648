"""Exact dedup: a streaming job whose keyed state never expires.

The documents arrive as a file stream.  The state, kept on disk by RocksDB and
in the stream's checkpoint, holds for each digest of a normalised text the
stable identifier of the text that stays, the locator of its content (file and
row) and the number of rows seen.  The state operator is a streaming
aggregate: every task folds its rows per digest before the shuffle, so a text
that a third of the rows repeat reaches its state partition as one row a task.

A hit is a row whose digest the state holds under another locator.  Each hit's
full bytes are then compared with those found through the stored locator; rows
that differ (a digest collision) are grouped by their whole text instead.

Defined cases: a null text is empty; a null id comes last; rows that repeat
the smallest id are ordered by content locator, so one row of each group
stays; an empty table gives an empty result; other columns are carried by
``dedup_table`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import SPACE_RUN, materialise, scratch, small
from keyfold.streaming.pipeline import stream_session

#: Input bytes of a micro-batch (a bound on what one batch shuffles).
BATCH_BYTES = 256 << 30
#: Memory of an executor's state stores (their data lie on disk), in MB.
STORE_MB = "128"
#: Rows of one group that a single task compares with the text that stays.
SALT_ROWS = 2000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _at(df: DataFrame) -> Column:
    """The content locator of each row, whatever columns ``df`` has."""
    of_file = df.metadataColumn("_metadata")
    return F.struct(of_file["file_path"].alias("file"), of_file["row_index"].alias("row")).alias("at")


def _located(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Identifier, digest and content locator of each row."""
    return df.select(F.col(id_col).alias("id"), digest(normalised(F.col(text_col))).alias("digest"), _at(df))


def run_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """Feed every file of ``path`` that ``checkpoint`` has not seen through the
    state, and read the state back: digest, stays (id, at), n."""
    stream = stream_session(spark)
    # many small stores: do not reserve log space for each in advance, and let
    # those of an executor share one bounded block cache
    for key, value in (("allowFAllocate", "false"), ("boundedMemoryUsage", "true"), ("maxMemoryUsageMB", STORE_MB)):
        stream.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{key}", value)
    checkpoint = checkpoint or scratch(spark, "dedup-state")
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", batch_bytes)
    reader = stream.readStream.schema(spark.read.parquet(path).schema).option(*limit)
    # as a glob the path may be one file or a folder; a stream takes only folders otherwise
    stem = path.rstrip("/")
    rows = _located(reader.parquet(f"{stem[:-1]}[{stem[-1]}]"), id_col, text_col, digest)
    # F.min over a struct orders by its fields: null ids last, then the locator
    state = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("stays"), F.count("*").alias("n")
    )
    state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    held = spark.read.format("statestore").load(checkpoint)
    value = held.schema["value"].dataType.names
    return held.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[value[0]].alias("stays"),
        F.col("value")[value[1]].alias("n"),
    )


def decide(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salt_rows: int = SALT_ROWS, **stream) -> DataFrame:
    """One row per row of ``path``: id, at, digest, keep_id, group_size, kept."""
    state = materialise(run_state(spark, path, id_col, text_col, digest, **stream), "dedup-held")
    docs = spark.read.parquet(path)
    rows = _located(docs, id_col, text_col, digest)
    joined = rows.join(state, "digest")
    plain = joined.select(
        "id", "at", "digest",
        F.col("stays.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("stays.at")).alias("kept"),
    )
    odd = materialise(_unequal(docs, state, text_col, digest, salt_rows), "dedup-unequal")
    if odd.isEmpty():
        return plain
    return _regrouped(docs, plain, odd, id_col, text_col, digest)


def _unequal(docs: DataFrame, state: DataFrame, text_col: str, digest, salt_rows: int) -> DataFrame:
    """Digests under which some hit's bytes differ from those of the text that
    stays, which is found through its locator.  Only texts of groups are
    shuffled (by a filter on 64 bits of the digest while the groups are few
    enough to broadcast); hits are salted by the size of their group, and the
    text that stays is copied once per salt: rows / ``salt_rows`` copies in all."""
    many = materialise(
        state.where("n > 1").select(
            "digest", "stays", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"), F.xxhash64("digest").alias("bits")
        ),
        "dedup-groups",
    )
    norm = normalised(F.col(text_col))
    rows = docs.select(_at(docs), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    bits = small(many.select("bits"))
    rows = rows.withColumn("bits", F.xxhash64("digest")).join(bits, "bits", "left_semi").drop("bits")
    first = rows.drop("digest").join(many.select("digest", F.col("stays.at").alias("at"), "salts"), "at").select(
        "digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("stored")
    )
    rest = rows.join(many.select("digest", "salts"), "digest").select(
        "digest", F.pmod(F.xxhash64("at"), F.col("salts")).cast("int").alias("salt"), "norm"
    )
    return rest.join(first, ["digest", "salt"]).where(F.col("norm") != F.col("stored")).select("digest").distinct()


def _regrouped(docs: DataFrame, plain: DataFrame, odd: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """The rows of colliding digests, grouped by their whole text."""
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), digest(norm).alias("digest"), norm.alias("norm"), _at(docs),
    )
    rows = rows.join(odd, "digest", "left_semi")
    groups = rows.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("stays"), F.count("*").alias("n")
    )
    again = rows.join(groups, ["digest", "norm"]).select(
        "id", "at", "digest", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("stays.at")).alias("kept"),
    )
    return plain.join(odd, "digest", "left_anti").unionByName(again)


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  The rows are
    first written to the shared folder: a stream needs input that can be
    replayed, and a locator needs files."""
    spark = docs.sparkSession
    path = scratch(spark, "dedup-docs")
    docs.write.parquet(path)
    dropped = materialise(
        decide(spark, path, id_col, text_col).where(~F.col("kept")).select("at.file", "at.row"), "dedup-dropped"
    )
    gone = small(dropped)
    stored = spark.read.schema(docs.schema).parquet(path)
    of_file = stored.metadataColumn("_metadata")
    same = (of_file["file_path"] == gone["file"]) & (of_file["row_index"] == gone["row"])
    return stored.join(gone, same, "left_anti").select(*[stored[c] for c in docs.columns])
