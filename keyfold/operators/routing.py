"""Decode, route and quarantine log records.

Every step is a column expression, so decode runs inside whole-stage
codegen and is a map-only stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import codecs

TOPICS = ("add-to-cart", "checkout", "restock")

# The fields that each topic's message declares.
_FIELDS = {
    "add-to-cart": ("userId", "itemId", "quantity", "publishTimestamp"),
    "checkout": ("userId", "publishTimestamp"),
    "restock": ("itemId", "quantity", "publishTimestamp"),
}


def route(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """F2 + U3 + P13: split each line into key and body and pick its topic."""
    key, body = codecs.split_key_line(value_col)
    return lines.withColumn("key", key).withColumn("body", body).withColumn(
        "topic", codecs.classify_body(F.coalesce(F.col("body"), F.lit("")))
    )


def decode(routed: DataFrame) -> DataFrame:
    """P1-P3 + F6: parse each body against its topic's schema.

    Adds ``userId, itemId, quantity (int), publishTimestamp, decoded (bool)``.
    As with the message format's own parser, a body decodes when it is a JSON
    object, has no field that its message does not declare, and its quantity,
    if there, spells a 32-bit integer.  An absent or null field is a default:
    0 or the empty text (publishTimestamp) or NULL (ids).

    The body is parsed once: the parsed map comes out of a generator, which the
    optimizer neither copies nor moves filters through.
    """
    d = routed.select("*", F.explode(F.array(codecs.parse_message("body"))).alias("_m"))
    m = F.col("_m")
    known = None
    for topic, fields in _FIELDS.items():
        cond = F.col("topic") == topic
        value = F.array(*[F.lit(f) for f in fields])
        known = F.when(cond, value) if known is None else known.when(cond, value)
    number = codecs.whole_number(m["quantity"])
    ok = m.isNotNull() & (F.size(F.array_except(F.map_keys(m), known)) == 0) & (m["quantity"].isNull() | number.isNotNull())
    return d.select(
        *[F.col(c) for c in routed.columns],
        m["userId"].alias("userId"),
        m["itemId"].alias("itemId"),
        F.coalesce(number, F.lit(0)).alias("quantity"),
        F.coalesce(m["publishTimestamp"], F.lit("")).alias("publishTimestamp"),
        F.coalesce(ok, F.lit(False)).alias("decoded"),
    )


def rejects(decoded: DataFrame) -> DataFrame:
    """Records that do not decode; the job goes on, they go aside."""
    return decoded.where(~F.col("decoded")).select(
        "key", "value", "topic", F.lit("undecodable").alias("reason")
    )


def poison_reason(message_col: str | None = None):
    """Why a record is poison, or NULL: a negative quantity on an add,
    an empty message, or a type that is none of the topics."""
    reason = F.when(
        (F.col("topic") == "add-to-cart") & F.col("decoded") & (F.col("quantity") < 0), F.lit("negative_quantity")
    )
    if message_col is not None:
        reason = reason.when(F.col(message_col) == "", F.lit("empty_message"))
    return reason.when(~F.col("topic").isin(*TOPICS), F.lit("unknown_type"))


def accepted(decoded: DataFrame, topic: str) -> DataFrame:
    """Decoded records of a topic that are not poison: with ``rejects`` and
    ``quarantine`` a partition of the log.  A job that replays after a crash
    and then processes its poison (R12) unions the quarantine back in."""
    return decoded.where(F.col("decoded") & (F.col("topic") == topic) & poison_reason().isNull())


def quarantine(decoded: DataFrame, message_col: str | None = None) -> DataFrame:
    """Poison records with their reason.  The reference crashes on them
    once and then processes them on replay; here they are split off so the job
    never has to crash (use ``strict`` for the crash)."""
    return decoded.withColumn("reason", poison_reason(message_col)).where(F.col("reason").isNotNull())


def strict(decoded: DataFrame) -> DataFrame:
    """F3 strict mode: fail the query on a poison record (``raise_error``)."""
    bad = (F.col("topic") == "add-to-cart") & F.col("decoded") & (F.col("quantity") < 0)
    return decoded.withColumn(
        "quantity",
        F.when(bad, F.raise_error(F.concat(F.lit("poison record: "), F.col("value")))).otherwise(
            F.col("quantity")
        ),
    )
