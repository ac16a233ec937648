"""Driver tables -> domain events (mapping fixed in FIXTURES.md section 2).

| event_type   | domain event | fields                                         |
| click, view  | add_to_cart  | user = user_id, item = props.k, q = 1 + id % 9 |
| purchase     | checkout     | user = user_id                                 |
| signup       | restock      | item = props.k, q = profile.restock_qty        |
| error        | undecodable  | reject side                                    |

Only the columns a query needs are selected, so the parquet scan reads a
pruned schema; the kind filter is pushed to the scan as an ``IN`` predicate.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.timefns import epoch_ms

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the mapping (FIXTURES.md section 2).
ADD_TYPES = ("click", "view")
CHECKOUT_TYPES = ("purchase",)
RESTOCK_TYPES = ("signup",)
REJECT_TYPES = ("error",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def kind_col() -> F.Column:
    et = F.col("event_type")
    return (
        F.when(et.isin(*ADD_TYPES), F.lit("add"))
        .when(et.isin(*CHECKOUT_TYPES), F.lit("checkout"))
        .when(et.isin(*RESTOCK_TYPES), F.lit("restock"))
        .otherwise(F.lit("reject"))
    )


def item_col() -> F.Column:
    return F.get_json_object(F.col("props"), "$.k").try_cast("long")


def raw_add_quantity() -> F.Column:
    """Quantity an add carries: ``1 + event_id % 9`` (1..9, like the generator)."""
    return (F.lit(1) + F.pmod(F.col("event_id"), F.lit(9))).cast("int")


def of_kinds(events: DataFrame, kinds: tuple[str, ...] = ("add", "checkout", "restock")) -> DataFrame:
    """The rows of ``events`` that are domain events of ``kinds``."""
    types = []
    for k, ts_ in (("add", ADD_TYPES), ("checkout", CHECKOUT_TYPES),
                   ("restock", RESTOCK_TYPES), ("reject", REJECT_TYPES)):
        if k in kinds:
            types.extend(ts_)
    return events.where(F.col("event_type").isin(*types))


def domain_events(
    events: DataFrame,
    restock_qty: int,
    kinds: tuple[str, ...] = ("add", "checkout", "restock"),
) -> DataFrame:
    """Union frame of domain events (U1): one row per event, tagged by ``kind``.

    Columns: event_id, ts, ts_ms, kind, user_id, item_id, quantity.
    ``quantity`` is the raw add quantity or the restock amount; the request a
    profile makes from it is decided later (R3).
    """
    kind = kind_col()
    return (
        of_kinds(events, kinds)
        .select(
            "event_id",
            "ts",
            epoch_ms("ts").alias("ts_ms"),
            kind.alias("kind"),
            F.when(kind != "restock", F.col("user_id")).alias("user_id"),
            F.when(kind.isin("add", "restock"), item_col()).alias("item_id"),
            F.when(kind == "add", raw_add_quantity())
            .when(kind == "restock", F.lit(restock_qty))
            .cast("int")
            .alias("quantity"),
        )
    )


# SQL text of the same mapping, used by the DuckDB oracle.
DOMAIN_EVENTS_SQL = """
SELECT event_id, ts, (epoch_us(ts) // 1000) AS ts_ms,
       CASE WHEN event_type IN ('click','view') THEN 'add'
            WHEN event_type = 'purchase' THEN 'checkout'
            WHEN event_type = 'signup' THEN 'restock' ELSE 'reject' END AS kind,
       CASE WHEN event_type <> 'signup' THEN user_id END AS user_id,
       CASE WHEN event_type IN ('click','view','signup')
            THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS item_id,
       CASE WHEN event_type IN ('click','view') THEN CAST(1 + event_id % 9 AS INTEGER)
            WHEN event_type = 'signup' THEN CAST({restock_qty} AS INTEGER) END AS quantity
FROM events WHERE event_type IN ({types})
"""


def domain_events_sql(restock_qty: int, kinds=("add", "checkout", "restock")) -> str:
    m = {"add": ADD_TYPES, "checkout": CHECKOUT_TYPES, "restock": RESTOCK_TYPES, "reject": REJECT_TYPES}
    types = ",".join(f"'{t}'" for k in kinds for t in m[k])
    return DOMAIN_EVENTS_SQL.format(restock_qty=restock_qty, types=types)
