"""Carts, confirmations and receipts per user.

Settled adds carry their user (J2: the reply goes back to the caller), so the
user stage is a second keyed pass over ``settled adds UNION checkouts`` in
the total order ``(ts, event_id)`` (J3: a checkout sees every earlier
settled add).

* clear (embedded, R7): ``cart_no`` = checkouts strictly before the row (W2,
  a skew-safe running count).  A checkout carries the number of the cart it
  closes, so one aggregate per ``(user, cart_no)`` over the windowed rows
  gives the basket and its closing checkout together (no join, one window
  pass); a receipt only when at least one add was granted.  The aggregate
  is map-side combined, so a hot user does not make a hot task.
* running (remote, R8): running sum of granted quantities (W3); every
  checkout gets a receipt and nothing is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import codecs
from keyfold.functions.timefns import publish_timestamp
from keyfold.operators import scan
from keyfold.operators.reserve import INSTOCK
from keyfold.profiles import Profile

USER = "user_id"


def _granted_qty():
    return F.when(F.col("status") == INSTOCK, F.col("requested")).otherwise(F.lit(0))


def cart_stream(settled: DataFrame, domain: DataFrame) -> DataFrame:
    """Settled adds and checkouts in one frame keyed by user."""
    adds = settled.where(F.col("kind") == "add").select(
        "event_id", "ts", "ts_ms", "kind", USER, "item_id", "requested", "status"
    )
    checkouts = domain.where(F.col("kind") == "checkout").select(
        "event_id", "ts", "ts_ms", "kind", USER,
        F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("int").alias("requested"),
        F.lit(None).cast("string").alias("status"),
    )
    return adds.unionByName(checkouts).where(F.col(USER).isNotNull())


def with_cart_no(stream: DataFrame, chunking: scan.Chunking) -> DataFrame:
    """Cart number per user = checkouts strictly before the row."""
    return scan.running_sums(
        stream, [USER], {"cart_no": (F.col("kind") == "checkout").cast("long")}, chunking, exclusive=True
    )


def baskets(carts: DataFrame) -> DataFrame:
    """A1 per cart: granted units, granted add count, and the closing checkout
    (event id and time; NULL for a cart still open) per (user, cart_no)."""
    chk = F.col("kind") == "checkout"
    return carts.groupBy(USER, "cart_no").agg(
        F.sum(_granted_qty()).cast("long").alias("n_items"),
        F.sum(F.when(F.col("status") == INSTOCK, 1).otherwise(0)).cast("long").alias("n_granted"),
        F.max(F.when(chk, F.col("event_id"))).alias("event_id"),
        F.max(F.when(chk, F.col("ts_ms"))).alias("ts_ms"),
    )


def receipts(
    settled: DataFrame,
    domain: DataFrame,
    profile: Profile,
    chunking: scan.Chunking | None = None,
) -> DataFrame:
    """Receipts per the profile's checkout rule.

    Columns: user_id, event_id (of the checkout), n_items, receipt,
    publishTimestamp.
    """
    stream = cart_stream(settled, domain)
    if chunking is None:
        chunking = scan.choose_chunking(stream)
    if profile.checkout == "clear":
        out = baskets(with_cart_no(stream, chunking)).where(
            F.col("event_id").isNotNull() & (F.col("n_granted") > 0)
        )
    elif profile.checkout == "running":
        run = scan.running_sums(stream, [USER], {"n_items": _granted_qty().cast("long")}, chunking)
        out = run.where(F.col("kind") == "checkout").select(USER, "event_id", "ts_ms", "n_items")
    else:
        raise ValueError(f"profile {profile.name} emits no receipts")
    return out.select(
        USER,
        "event_id",
        F.col("n_items").cast("long").alias("n_items"),
        codecs.receipt_text(profile.receipt_format, F.col(USER), F.col("n_items")).alias("receipt"),
        publish_timestamp("ts_ms").alias("publishTimestamp"),
    )


def add_confirms(settled: DataFrame) -> DataFrame:
    """One confirmation per add, either outcome, with no status.

    The quantity is what was requested (R3), the key is the user (S4).
    """
    adds = settled.where(F.col("kind") == "add")
    return adds.select(
        F.col(USER).cast("string").alias("userId"),
        F.col("item_id").cast("string").alias("itemId"),
        F.col("requested").alias("quantity"),
        publish_timestamp("ts_ms").alias("publishTimestamp"),
        "event_id",
        codecs.encode_add_to_cart(F.col(USER), F.col("item_id"), F.col("requested"), publish_timestamp("ts_ms")).alias(
            "value"
        ),
    )


def echo_confirms(domain: DataFrame) -> DataFrame:
    """R13 (simple): the add is echoed at once with its raw quantity."""
    return settled_echo(domain).transform(add_confirms)


def settled_echo(domain: DataFrame) -> DataFrame:
    return domain.where(F.col("kind") == "add").select(
        "event_id", "ts", "ts_ms", "kind", USER, "item_id",
        F.col("quantity").alias("requested"),
        F.lit(None).cast("int").alias("restock"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("long").alias("stock_after"),
    )


def basket_items(
    settled: DataFrame, domain: DataFrame, chunking: scan.Chunking | None = None
) -> DataFrame:
    """A2/A4: granted quantity per (user, cart_no, item); cleared carts (clear rule)."""
    stream = cart_stream(settled, domain)
    if chunking is None:
        chunking = scan.choose_chunking(stream)
    carts = with_cart_no(stream, chunking)
    return (
        carts.where((F.col("kind") == "add") & (F.col("status") == INSTOCK))
        .groupBy(USER, "cart_no", "item_id")
        .agg(F.sum("requested").cast("long").alias("quantity"))
    )


def receipt_lines(
    settled: DataFrame, domain: DataFrame, chunking: scan.Chunking | None = None
) -> DataFrame:
    """Per-item receipt text of each cart with a basket, lines sorted by item.

    ``User {id} receipt: \\n`` then ``Item: {item}, Quantity: {q}\\n`` per
    item.  Two aggregates over one window pass: per (user, cart, item) --
    the closing checkout rides along as the row with no item -- then per
    cart, whose list is bounded by its distinct items.
    """
    stream = cart_stream(settled, domain)
    if chunking is None:
        chunking = scan.choose_chunking(stream)
    carts = with_cart_no(stream, chunking).where(
        (F.col("kind") == "checkout") | (F.col("status") == INSTOCK)
    )
    chk = F.col("kind") == "checkout"
    per_item = carts.groupBy(USER, "cart_no", F.when(~chk, F.col("item_id")).alias("item_id")).agg(
        F.sum(F.when(~chk, F.col("requested"))).cast("long").alias("q"),
        F.max(F.when(chk, F.col("event_id"))).alias("event_id"),
    )
    line = F.when(
        F.col("item_id").isNotNull(),
        F.struct("item_id", F.concat(F.lit("Item: "), F.col("item_id").cast("string"), F.lit(", Quantity: "),
                                     F.col("q").cast("string"), F.lit("\n")).alias("text")),
    )
    per_cart = per_item.groupBy(USER, "cart_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "").alias("_lines"),
        F.max("event_id").alias("event_id"),
        F.count(line).alias("_n"),
    )
    return per_cart.where(F.col("event_id").isNotNull() & (F.col("_n") > 0)).select(
        USER,
        "event_id",
        F.concat(F.lit("User "), F.col(USER).cast("string"), F.lit(" receipt: \n"), F.col("_lines")).alias("receipt"),
    )


def cart_positions(domain: DataFrame, chunking: scan.Chunking | None = None) -> DataFrame:
    """Position of each add within its user's cart cycle (1-based).

    Both counts are skew-safe running sums per user: ``cart_no`` (checkouts
    before the row) and ``n_adds`` (adds up to the row).  A cart's first add
    has the smallest ``n_adds`` of the cart (a map-side aggregate per cart),
    so ``position = n_adds - first + 1``.  No window over a whole cart: a
    hot user's open cart never lands in one task (AQE splits a skewed join
    partition).
    """
    stream = domain.where(F.col("kind").isin("add", "checkout")).select("event_id", "ts", "ts_ms", "kind", USER)
    if chunking is None:
        chunking = scan.choose_chunking(stream)
    counted = scan.running_sums(
        stream,
        [USER],
        {"n_adds": (F.col("kind") == "add").cast("long"), "cart_no": (F.col("kind") == "checkout").cast("long")},
        chunking,
        exclusive={"cart_no"},
    ).where(F.col("kind") == "add")
    first = counted.groupBy(USER, "cart_no").agg(F.min("n_adds").alias("_first"))
    return counted.join(first, [USER, "cart_no"]).select(
        USER, "event_id", "cart_no", (F.col("n_adds") - F.col("_first") + 1).cast("long").alias("position")
    )


def basket_maps(items: DataFrame) -> DataFrame:
    """A cart's basket as ``map<item, quantity>`` (bounded by the cart's
    distinct items), from ``basket_items`` rows."""
    return items.groupBy(USER, "cart_no").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "quantity"))).alias("basket")
    )


def basket_with_removals(
    df: DataFrame, signed_qty: str = "quantity", chunking: scan.Chunking | None = None
) -> DataFrame:
    """A3: per (user, item) basket after adds (+q) and removals (-q); an entry
    that would drop to zero or below is removed (quantity 0).

    That is a counter floored at zero, so it is the skew-safe reflected scan
    with an initial level of 0.  Adds ``basket_qty`` per row.
    """
    keys = [USER, "item_id"]
    if chunking is None:
        chunking = scan.choose_chunking(df)
    lv = scan.reflected_level(df, keys, F.col(signed_qty), 0, chunking)
    return lv.withColumn("basket_qty", F.col("_level") - F.col("_m")).drop("_level", "_m", "_m_prev")
