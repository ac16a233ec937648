"""Synthetic skewed event sets as Spark jobs (P25-P29, S14, generator).

The reference generator is a single-process loop.  Here every row is a pure
function of a row id and a seed (``functions.synth``), so generation is a
map-only stage over any id source -- ``spark.range`` for a fixed size, or a
driver table so that the output grows with it -- and recomputing a lost
partition yields identical rows.

``events`` draws independent requests; ``cart_cycles`` draws whole carts (a
user, a number of adds, the checkout behind them), so that users fill carts
and check them out without a loop over users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import codecs
from keyfold.functions import synth as R

# Fixed values of the reference generator.
USER_ID_LEN = 20
ITEM_ID_LEN = 16
MAX_QUANTITY = 9
MAX_ADDS = 10
RESTOCK_SHARE_DEN = 21  # randint(0, 20) == 0
RESTOCK_AMOUNT = 300


def checkout_den(max_adds: int = MAX_ADDS) -> int:
    """Mean cycle: 1 + randint(1, max_adds - 1) adds, then one checkout."""
    mean_adds = 1 + max_adds / 2.0
    return int(round(mean_adds + 1))


def events(
    ids: DataFrame,
    id_col: str,
    n_users: int,
    n_items: int,
    power_a: float = 3.0,
    unique_users: bool = False,
) -> DataFrame:
    """One synthetic request per id.

    Columns: seq, kind (add | checkout | restock), user_idx, item_idx,
    userId, itemId, quantity.  ``unique_users`` gives every row its own user
    (the large-state generator).
    """
    seq = F.col(id_col).cast("long")
    action = R.uniform_int(seq, 0, RESTOCK_SHARE_DEN - 1, seed=4)
    chk = R.uniform_int(seq, 0, checkout_den() - 1, seed=5)
    kind = (
        F.when(action == 0, F.lit("restock"))
        .when(chk == 0, F.lit("checkout"))
        .otherwise(F.lit("add"))
    )
    user_idx = seq if unique_users else R.power_law_index(seq, n_users, power_a, seed=1)
    item_idx = R.power_law_index(seq, n_items, power_a, seed=2)
    qty = R.uniform_int(seq, 1, MAX_QUANTITY, seed=3).cast("int")
    return ids.select(
        seq.alias("seq"),
        kind.alias("kind"),
        F.when(kind != "restock", user_idx).alias("user_idx"),
        F.when(kind != "checkout", item_idx).alias("item_idx"),
        qty.alias("_q"),
    ).select(
        "seq",
        "kind",
        "user_idx",
        "item_idx",
        F.when(F.col("user_idx").isNotNull(), R.id_string("user_idx", USER_ID_LEN)).alias("userId"),
        F.when(F.col("item_idx").isNotNull(), R.id_string("item_idx", ITEM_ID_LEN)).alias("itemId"),
        F.when(F.col("kind") == "add", F.col("_q"))
        .when(F.col("kind") == "restock", F.lit(RESTOCK_AMOUNT))
        .cast("int")
        .alias("quantity"),
    )


def cart_cycles(ids: DataFrame, id_col: str, n_users: int, n_items: int, power_a: float = 3.0) -> DataFrame:
    """One cart per id: 2 to ``MAX_ADDS`` adds of one user, then the checkout.

    Columns: cart, step (1 ..), kind, user_idx, item_idx, quantity.
    """
    cart = F.col(id_col).cast("long")
    carts = ids.select(
        cart.alias("cart"),
        R.power_law_index(cart, n_users, power_a, seed=11).alias("user_idx"),
        R.uniform_int(cart, 2, MAX_ADDS, seed=12).alias("_adds"),
    )
    steps = carts.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_adds") + 1)))
    add = F.col("step") <= F.col("_adds")
    row = F.concat_ws("/", "cart", "step")
    return steps.select(
        "cart", "step", F.when(add, F.lit("add")).otherwise(F.lit("checkout")).alias("kind"), "user_idx",
        F.when(add, R.power_law_index(row, n_items, power_a, seed=13)).alias("item_idx"),
        F.when(add, R.uniform_int(row, 1, MAX_QUANTITY, seed=14)).cast("int").alias("quantity"),
    )


def to_lines(ev: DataFrame, stamp) -> DataFrame:
    """The generator's ``key=json`` lines."""
    add = F.to_json(F.struct(F.col("userId"), F.col("quantity"), F.col("itemId"), stamp.alias("publishTimestamp")))
    chk = F.to_json(F.struct(F.col("userId"), stamp.alias("publishTimestamp")))
    rst = F.to_json(F.struct(F.col("itemId"), F.col("quantity"), stamp.alias("publishTimestamp")))
    line = (
        F.when(F.col("kind") == "add", codecs.key_line(F.col("userId"), add))
        .when(F.col("kind") == "checkout", codecs.key_line(F.col("userId"), chk))
        .otherwise(codecs.key_line(F.col("itemId"), rst))
    )
    return ev.withColumn("value", line)


def endless_replay(lines: DataFrame, rounds: int, period_ms: int, ts_ms: str = "ts_ms") -> DataFrame:
    """Replay the data set ``rounds`` times, time shifted per round.

    Each row emits its ``rounds`` copies with a generator (no join).
    """
    return lines.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        ts_ms, F.col(ts_ms) + F.col("round").cast("long") * F.lit(period_ms)
    )
