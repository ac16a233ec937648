"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables.  Oracles are written independently of the Spark plan
(stock by a recursive CTE fold, not by the window algebra).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import synth as R
from keyfold.operators import carts, keyed, reserve, routing
from keyfold.operators import latency as lat
from keyfold.operators import synth as syn
from keyfold.plans import params as P
from keyfold.sources import eventlog, latencylog
from keyfold.sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def _domain(spark, sf_dir, profile, kinds=("add", "checkout", "restock")):
    return td.domain_events(td.table(spark, sf_dir, "events"), profile.restock_qty, kinds)


def _settled(spark, sf_dir, profile):
    kinds = ("add", "restock") if profile.restock_applies else ("add",)
    return reserve.reserve(_domain(spark, sf_dir, profile, kinds), profile)


# ---------------------------------------------------------------- oracle SQL
def _fold_cte(profile) -> str:
    """Recursive-CTE fold of the stock per item (independent of W1a/W1b)."""
    kinds = ("add", "restock") if profile.restock_applies else ("add",)
    dom = td.domain_events_sql(profile.restock_qty, kinds)
    req = "CASE WHEN quantity < 0 THEN quantity ELSE 1 END" if profile.demand == "unit" else "quantity"
    init = int(profile.initial_stock)
    return f"""
r AS (
  SELECT item_id, event_id, ts, kind, user_id,
         CAST(CASE WHEN kind = 'add' THEN {req} END AS INTEGER) AS requested,
         CAST(CASE WHEN kind = 'restock' THEN quantity END AS INTEGER) AS restock,
         row_number() OVER (PARTITION BY item_id ORDER BY ts, event_id) AS rn
  FROM ({dom}) d WHERE item_id IS NOT NULL),
f AS (
  SELECT item_id, rn,
         CASE WHEN kind = 'add' THEN CASE WHEN {init} >= requested THEN 'INSTOCK' ELSE 'OUTOFSTOCK' END END AS status,
         CAST(CASE WHEN kind = 'add' THEN CASE WHEN {init} >= requested THEN {init} - requested ELSE {init} END
              ELSE {init} + restock END AS BIGINT) AS stock_after
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.item_id, r.rn,
         CASE WHEN r.kind = 'add' THEN CASE WHEN f.stock_after >= r.requested THEN 'INSTOCK' ELSE 'OUTOFSTOCK' END END,
         CAST(CASE WHEN r.kind = 'add' THEN CASE WHEN f.stock_after >= r.requested THEN f.stock_after - r.requested
              ELSE f.stock_after END ELSE f.stock_after + r.restock END AS BIGINT)
  FROM f JOIN r ON r.item_id = f.item_id AND r.rn = f.rn + 1),
settled AS (SELECT r.*, f.status, f.stock_after FROM r JOIN f USING (item_id, rn))"""


def _settled_sql(profile, select: str) -> str:
    return f"WITH RECURSIVE {_fold_cte(profile)}\n{select}"


RESERVE_SELECT = """SELECT event_id, item_id, user_id, requested, status, stock_after
FROM settled WHERE kind = 'add'"""

OUTCOME_SELECT = """SELECT item_id,
  CAST(SUM(CASE WHEN status = 'INSTOCK' THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted,
  CAST(SUM(CASE WHEN status = 'OUTOFSTOCK' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected,
  CAST(arg_max(stock_after, rn) AS BIGINT) AS final_stock
FROM settled GROUP BY item_id"""


def _reserve_out(df: DataFrame) -> DataFrame:
    return df.where(F.col("kind") == "add").select(
        "event_id", "item_id", "user_id", "requested", "status", "stock_after"
    )


@register("reserve_unit", _settled_sql(P.UNIT, RESERVE_SELECT))
def q_reserve_unit(spark, sf_dir):
    """Unit demand, stock 5, restock +3."""
    return _reserve_out(_settled(spark, sf_dir, P.UNIT))


@register("reserve_any", _settled_sql(P.ANY, RESERVE_SELECT))
def q_reserve_any(spark, sf_dir):
    """Real quantities (remote), stock 40, restock +12."""
    return _reserve_out(_settled(spark, sf_dir, P.ANY))


@register("reserve_embedded", _settled_sql(P.EMBEDDED, RESERVE_SELECT))
def q_reserve_embedded(spark, sf_dir):
    """Embedded ignores restocks; unit demand, stock 5."""
    return _reserve_out(_settled(spark, sf_dir, P.EMBEDDED))


@register("item_accept_reject", _settled_sql(P.UNIT, OUTCOME_SELECT))
def q_item_accept_reject(spark, sf_dir):
    """Per item granted / refused adds and final stock (unit demand)."""
    return reserve.item_outcomes(_settled(spark, sf_dir, P.UNIT))


@register("final_stock", _settled_sql(P.ANY, OUTCOME_SELECT))
def q_final_stock(spark, sf_dir):
    """A5 for the any-demand fold (remote)."""
    return reserve.item_outcomes(_settled(spark, sf_dir, P.ANY))


CONFIRM_SELECT = """SELECT CAST(user_id AS VARCHAR) AS userId, CAST(item_id AS VARCHAR) AS itemId,
  requested AS quantity, CAST((epoch_us(ts) // 1000) AS VARCHAR) AS publishTimestamp, event_id,
  '{"userId":"' || CAST(user_id AS VARCHAR) || '","itemId":"' || CAST(item_id AS VARCHAR) || '"'
  || CASE WHEN requested <> 0 THEN ',"quantity":' || CAST(requested AS VARCHAR) ELSE '' END
  || ',"publishTimestamp":"' || CAST((epoch_us(ts) // 1000) AS VARCHAR) || '"}' AS value
FROM settled WHERE kind = 'add'"""


@register("add_confirms", _settled_sql(P.UNIT, CONFIRM_SELECT))
def q_add_confirms(spark, sf_dir):
    """One confirmation per add, no status."""
    return carts.add_confirms(_settled(spark, sf_dir, P.UNIT))


def _cart_sql(profile, select: str) -> str:
    chk = td.domain_events_sql(profile.restock_qty, ("checkout",))
    return f"""WITH RECURSIVE {_fold_cte(profile)},
cs AS (
  SELECT event_id, ts, kind, user_id, item_id, requested, status FROM settled WHERE kind = 'add'
  UNION ALL
  SELECT event_id, ts, kind, user_id, NULL, NULL, NULL FROM ({chk}) c),
cn AS (
  SELECT *, CAST(COALESCE(SUM(CASE WHEN kind = 'checkout' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cart_no,
    CAST(SUM(CASE WHEN status = 'INSTOCK' THEN requested ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
  FROM cs WHERE user_id IS NOT NULL)
{select}"""


RECEIPT_CLEAR_SELECT = """, b AS (
  SELECT user_id, cart_no,
    CAST(SUM(CASE WHEN status = 'INSTOCK' THEN requested ELSE 0 END) AS BIGINT) AS n_items,
    SUM(CASE WHEN status = 'INSTOCK' THEN 1 ELSE 0 END) AS n_granted
  FROM cn WHERE kind = 'add' GROUP BY user_id, cart_no)
SELECT c.user_id, c.event_id, b.n_items,
  'User ' || CAST(c.user_id AS VARCHAR) || ' receipt: ' || CAST(b.n_items AS VARCHAR) || ' items' AS receipt,
  CAST((epoch_us(c.ts) // 1000) AS VARCHAR) AS publishTimestamp
FROM cn c JOIN b ON c.user_id = b.user_id AND c.cart_no = b.cart_no
WHERE c.kind = 'checkout' AND b.n_granted > 0"""

RECEIPT_RUNNING_SELECT = """SELECT user_id, event_id, running AS n_items,
  'Total items: ' || CAST(running AS VARCHAR) AS receipt,
  CAST((epoch_us(ts) // 1000) AS VARCHAR) AS publishTimestamp
FROM cn WHERE kind = 'checkout'"""

BASKET_ITEMS_SELECT = """SELECT user_id, cart_no, item_id, CAST(SUM(requested) AS BIGINT) AS quantity
FROM cn WHERE kind = 'add' AND status = 'INSTOCK' GROUP BY user_id, cart_no, item_id"""

RECEIPT_LINES_SELECT = """, it AS (
  SELECT user_id, cart_no, item_id, CAST(SUM(requested) AS BIGINT) AS q
  FROM cn WHERE kind = 'add' AND status = 'INSTOCK' GROUP BY user_id, cart_no, item_id),
l AS (
  SELECT user_id, cart_no,
    string_agg('Item: ' || CAST(item_id AS VARCHAR) || ', Quantity: ' || CAST(q AS VARCHAR) || chr(10), '' ORDER BY item_id, q) AS lines
  FROM it GROUP BY user_id, cart_no)
SELECT c.user_id, c.event_id, 'User ' || CAST(c.user_id AS VARCHAR) || ' receipt: ' || chr(10) || l.lines AS receipt
FROM cn c JOIN l ON c.user_id = l.user_id AND c.cart_no = l.cart_no WHERE c.kind = 'checkout'"""


def _receipts(spark, sf_dir, profile):
    settled = _settled(spark, sf_dir, profile)
    return carts.receipts(settled, _domain(spark, sf_dir, profile, ("checkout",)), profile)


@register("receipts_clear", _cart_sql(P.UNIT, RECEIPT_CLEAR_SELECT))
def q_receipts_clear(spark, sf_dir):
    """Receipt only with a basket, then clear."""
    return _receipts(spark, sf_dir, P.UNIT)


@register("receipts_running", _cart_sql(P.ANY, RECEIPT_RUNNING_SELECT))
def q_receipts_running(spark, sf_dir):
    """Always a receipt, running basket never cleared."""
    return _receipts(spark, sf_dir, P.ANY)


@register("basket_items", _cart_sql(P.UNIT, BASKET_ITEMS_SELECT))
def q_basket_items(spark, sf_dir):
    """A2, A4: granted quantity per (user, cart, item)."""
    settled = _settled(spark, sf_dir, P.UNIT)
    return carts.basket_items(settled, _domain(spark, sf_dir, P.UNIT, ("checkout",)))


@register("receipt_lines", _cart_sql(P.UNIT, RECEIPT_LINES_SELECT))
def q_receipt_lines(spark, sf_dir):
    """Per-item receipt lines, sorted by item."""
    settled = _settled(spark, sf_dir, P.UNIT)
    return carts.receipt_lines(settled, _domain(spark, sf_dir, P.UNIT, ("checkout",)))


# ------------------------------------------------------------ latency suite


def _lf(spark, sf_dir):
    log = latencylog.from_events(td.table(spark, sf_dir, "events"), P.N_RUNS)
    return lat.latency_frame(log, P.BUCKET_MS, P.RUN_SHIFTS)


def _rows(spark, sf_dir):
    return lat.latency_rows(latencylog.from_events(td.table(spark, sf_dir, "events"), P.N_RUNS))


def _shift_sql(col: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in P.RUN_SHIFTS.items())
    return f"CASE {col} {whens} ELSE 0 END"


LF_SQL = f"""WITH l AS (
  SELECT CAST(event_id % {P.N_RUNS} AS BIGINT) AS run, (epoch_us(ts) // 1000) AS in_ms,
         (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) AS out_ms FROM events),
o AS (SELECT run, min(in_ms) AS t0 FROM l GROUP BY run),
lf AS (
  SELECT l.run, in_ms, out_ms, out_ms - in_ms AS latency,
    CAST(floor((in_ms - t0) / {P.BUCKET_MS}) AS BIGINT) + {_shift_sql('l.run')} AS start_bucket,
    CAST(floor((out_ms - t0) / {P.BUCKET_MS}) AS BIGINT) + {_shift_sql('l.run')} AS end_bucket
  FROM l JOIN o ON l.run = o.run)
"""


@register("latency_by_start_bucket", LF_SQL + """SELECT run, start_bucket, avg(latency) AS mean_latency,
  count(*) AS n_events FROM lf GROUP BY run, start_bucket""")
def q_latency_by_start_bucket(spark, sf_dir):
    """P19-P21, P23, A6, J6, O1."""
    return lat.latency_by_start_bucket(_lf(spark, sf_dir))


@register("throughput_by_end_bucket", LF_SQL + """SELECT run, end_bucket, count(*) AS n_events
FROM lf GROUP BY run, end_bucket""")
def q_throughput_by_end_bucket(spark, sf_dir):
    """A7."""
    return lat.throughput_by_end_bucket(_lf(spark, sf_dir))


@register("throughput_gap_filled", LF_SQL + """, c AS (SELECT run, end_bucket, count(*) AS n FROM lf GROUP BY run, end_bucket),
sp AS (SELECT r.run, CAST(unnest(range(0, m.xm)) AS BIGINT) AS end_bucket
       FROM (SELECT DISTINCT run FROM lf) r, (SELECT max(end_bucket) AS xm FROM lf) m)
SELECT sp.run, sp.end_bucket, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_events
FROM sp LEFT JOIN c ON sp.run = c.run AND sp.end_bucket = c.end_bucket""")
def q_throughput_gap_filled(spark, sf_dir):
    """Spine 0 .. x_max-1 (last bucket dropped as in the reference)."""
    return lat.throughput_gap_filled(_lf(spark, sf_dir))


@register("latency_ten_bucket", LF_SQL + """SELECT run, CAST(floor(start_bucket / 10) * 10 AS BIGINT) AS ten_bucket,
  avg(latency) AS mean_latency, count(*) AS n_events FROM lf GROUP BY 1, 2""")
def q_latency_ten_bucket(spark, sf_dir):
    """P22."""
    return lat.latency_ten_bucket(_lf(spark, sf_dir))


@register("warm_window_stats", LF_SQL + f"""SELECT run,
  avg(CASE WHEN start_bucket BETWEEN {P.WARM_LO} AND {P.WARM_HI} THEN latency END) AS warm_mean_latency,
  count(CASE WHEN start_bucket BETWEEN {P.WARM_LO} AND {P.WARM_HI} THEN 1 END) / {float(P.WARM_DIVISOR)} AS warm_throughput,
  avg(CASE WHEN start_bucket < {P.PREFIX_LIMIT} THEN latency END) AS prefix_mean_latency,
  count(CASE WHEN start_bucket < {P.PREFIX_LIMIT} THEN 1 END) / {float(P.PREFIX_LIMIT)} AS prefix_throughput
FROM lf GROUP BY run""")
def q_warm_window_stats(spark, sf_dir):
    """F10, F11, A8, A9, U2."""
    return lat.warm_window_stats(_lf(spark, sf_dir), P.WARM_LO, P.WARM_HI, P.WARM_DIVISOR, P.PREFIX_LIMIT)


@register("latency_percentiles", LF_SQL + """SELECT run, quantile_cont(latency, 0.5) AS p50,
  quantile_cont(latency, 0.99) AS p99, min(latency) AS min_latency, max(latency) AS max_latency,
  count(*) AS n_events FROM lf GROUP BY run""")
def q_latency_percentiles(spark, sf_dir):
    """Exact percentiles per run."""
    return lat.latency_percentiles(_rows(spark, sf_dir))


def _spans_values_sql() -> str:
    inv = {v: k for k, v in P.RUN_LABELS.items()}
    return ", ".join(f"({inv[r]}, '{p}', {lo}, {hi})" for r, p, lo, hi in P.RECOVERY_SPANS)


@register("recovery_spans", LF_SQL + f""", b AS (SELECT run, start_bucket, avg(latency) AS mean_latency,
  count(*) AS n_events FROM lf GROUP BY run, start_bucket),
s AS (SELECT * FROM (VALUES {_spans_values_sql()}) t(run, plot, lo, hi) WHERE plot = 'latency')
SELECT b.run, b.start_bucket, b.mean_latency, b.n_events, s.lo IS NOT NULL AS in_recovery
FROM b LEFT JOIN s ON b.run = s.run AND b.start_bucket BETWEEN s.lo AND s.hi""")
def q_recovery_spans(spark, sf_dir):
    """Per-bucket mean latency tagged with the run's recovery span."""
    per_bucket = lat.latency_by_start_bucket(_lf(spark, sf_dir))
    spans = lat.recovery_spans(spark, P.RECOVERY_SPANS, P.RUN_LABELS)
    return lat.tag_recovery(per_bucket, spans, "latency", "start_bucket")


def _pivot_sql() -> str:
    cols = ", ".join(
        f"avg(CASE WHEN run = {k} THEN latency END) AS {v}" for k, v in P.RUN_LABELS.items()
    )
    return LF_SQL + f"SELECT CAST(floor(start_bucket / 10) * 10 AS BIGINT) AS ten_bucket, {cols} FROM lf GROUP BY 1"


@register("latency_pivot", _pivot_sql())
def q_latency_pivot(spark, sf_dir):
    """Runs side by side per ten-bucket (pivot with explicit values)."""
    return lat.latency_pivot(_lf(spark, sf_dir), P.RUN_LABELS)


@register("achieved_rate", LF_SQL + """SELECT run, count(*) AS n_events,
  (max(in_ms) - min(in_ms)) / 1000.0 AS elapsed_s,
  CASE WHEN max(in_ms) > min(in_ms) THEN count(*) / ((max(in_ms) - min(in_ms)) / 1000.0) END AS events_per_s
FROM lf GROUP BY run""")
def q_achieved_rate(spark, sf_dir):
    """Events per second over each run's span."""
    return lat.achieved_rate(_rows(spark, sf_dir))


# ------------------------------------------------------- log decode / route


def _lines(spark, sf_dir):
    return eventlog.lines_from_events(td.table(spark, sf_dir, "events"))


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') || '.0'"
_ITEM = "CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR)"
_U = "CAST(user_id AS VARCHAR)"
_Q = "CAST(1 + event_id % 9 AS INTEGER)"
_BODY_SQL = f"""CASE
  WHEN event_type IN ('click','view') THEN '{{"userId":"' || {_U} || '","quantity":' || CAST({_Q} AS VARCHAR)
       || ',"itemId":"' || {_ITEM} || '","publishTimestamp":"' || {_STAMP} || '"}}'
  WHEN event_type = 'purchase' THEN '{{"userId":"' || {_U} || '","publishTimestamp":"' || {_STAMP} || '"}}'
  WHEN event_type = 'signup' THEN '{{"itemId":"' || {_ITEM} || '","quantity":300,"publishTimestamp":"' || {_STAMP} || '"}}'
  ELSE '{{"userId":"' || {_U} || '","quantity":' END"""
_KEY_SQL = f"CASE WHEN event_type = 'signup' THEN {_ITEM} ELSE {_U} END"
_TOPIC_SQL = """CASE WHEN event_type IN ('click','view','error') THEN 'add-to-cart'
  WHEN event_type = 'purchase' THEN 'checkout' ELSE 'restock' END"""


@register("decode_adds", f"""SELECT {_U} AS key, {_U} AS userId, {_ITEM} AS itemId, {_Q} AS quantity,
  {_STAMP} AS publishTimestamp FROM events WHERE event_type IN ('click','view')""")
def q_decode_adds(spark, sf_dir):
    """P29 -> P13, P14, F2, P1: log lines encoded, then decoded back to adds."""
    dec = routing.decode(routing.route(_lines(spark, sf_dir)))
    return routing.accepted(dec, "add-to-cart").select("key", "userId", "itemId", "quantity", "publishTimestamp")


@register("rejects", f"""SELECT {_U} AS key, {_U} || '=' || ({_BODY_SQL}) AS value,
  'add-to-cart' AS topic, 'undecodable' AS reason FROM events WHERE event_type = 'error'""")
def q_rejects(spark, sf_dir):
    """Undecodable records go to the reject side."""
    return routing.rejects(routing.decode(routing.route(_lines(spark, sf_dir))))


@register("route_topics", f"""SELECT {_KEY_SQL} AS key, {_TOPIC_SQL} AS topic, ({_BODY_SQL}) AS body FROM events""")
def q_route_topics(spark, sf_dir):
    """Every line routed to one of three topics."""
    return routing.route(_lines(spark, sf_dir)).select("key", "topic", "body")


@register("quarantine_poison", f"""SELECT {_U} AS key, {_U} AS userId, {_ITEM} AS itemId, -1 AS quantity,
  {_STAMP} AS publishTimestamp, 'negative_quantity' AS reason
FROM events WHERE event_type IN ('click','view') AND datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) = {P.FAIL_PERIOD}
ORDER BY ts, event_id LIMIT 1""")
def q_quarantine_poison(spark, sf_dir):
    """Poison injected once (first add of the fail period), split off."""
    lines = eventlog.inject_poison_first_add(_lines(spark, sf_dir), P.FAIL_PERIOD)
    dec = routing.decode(routing.route(lines))
    return routing.quarantine(dec).select("key", "userId", "itemId", "quantity", "publishTimestamp", "reason")


# ---------------------------------------------------- keyed aggregates, synth


def _events(spark, sf_dir):
    return td.table(spark, sf_dir, "events")


@register("latest_per_user", """SELECT user_id, arg_max(props, ts) AS latest_message,
  arg_max(event_id, ts) AS latest_event_id, count(*) AS n_messages FROM events GROUP BY user_id""")
def q_latest_per_user(spark, sf_dir):
    """A18 (harness): latest message per user, message = props."""
    return keyed.latest_per_key(_events(spark, sf_dir), "user_id", "props")


@register("first_per_user", """SELECT user_id, arg_min(props, ts) AS first_message,
  arg_min(event_id, ts) AS first_event_id FROM events GROUP BY user_id""")
def q_first_per_user(spark, sf_dir):
    """First-seen message per user."""
    return keyed.first_per_key(_events(spark, sf_dir), "user_id", "props")


@register("item_frequency", """SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  count(*) AS n_events FROM events WHERE event_type IN ('click','view') GROUP BY 1""")
def q_item_frequency(spark, sf_dir):
    """Add requests per item."""
    adds = _domain(spark, sf_dir, P.UNIT, ("add",))
    return keyed.frequency(adds, "item_id")


@register("distinct_users_by_day", """WITH e AS (SELECT user_id, CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS period FROM events),
per AS (SELECT period, count(DISTINCT user_id) AS n_distinct FROM e GROUP BY period),
f AS (SELECT period, count(*) AS n_new FROM (SELECT user_id, min(period) AS period FROM e GROUP BY user_id) GROUP BY period)
SELECT per.period, per.n_distinct, CAST(COALESCE(f.n_new, 0) AS BIGINT) AS n_new,
  CAST(SUM(COALESCE(f.n_new, 0)) OVER (ORDER BY per.period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_cumulative
FROM per LEFT JOIN f ON per.period = f.period""")
def q_distinct_users_by_day(spark, sf_dir):
    """Distinct users per period, first-seen users, cumulative."""
    e = _events(spark, sf_dir).select("user_id", eventlog.period_col().alias("period"))
    return keyed.distinct_by_period(e, "user_id", "period")


def _synth_sql() -> str:
    u = {s: R.uniform_sql("event_id", s) for s in (1, 2, 3, 4, 5)}
    den = syn.checkout_den()
    kind = (f"CASE WHEN floor({u[4]} * {syn.RESTOCK_SHARE_DEN}) = 0 THEN 'restock' "
            f"WHEN floor({u[5]} * {den}) = 0 THEN 'checkout' ELSE 'add' END")
    user_idx = f"CAST(floor(pow({u[1]}, 1.0 / {P.SYN_POWER_A}) * {P.SYN_USERS}) AS BIGINT)"
    item_idx = f"CAST(floor(pow({u[2]}, 1.0 / {P.SYN_POWER_A}) * {P.SYN_ITEMS}) AS BIGINT)"
    qty = f"CAST(floor({u[3]} * {syn.MAX_QUANTITY}) + 1 AS INTEGER)"
    return f"""WITH b AS (SELECT event_id AS seq, {kind} AS kind, {user_idx} AS ui, {item_idx} AS ii, {qty} AS q FROM events),
c AS (SELECT seq, kind, CASE WHEN kind <> 'restock' THEN ui END AS user_idx,
  CASE WHEN kind <> 'checkout' THEN ii END AS item_idx, q FROM b)
SELECT seq, kind, user_idx, item_idx,
  substr(sha256(CAST(user_idx AS VARCHAR)), 1, {syn.USER_ID_LEN}) AS userId,
  substr(sha256(CAST(item_idx AS VARCHAR)), 1, {syn.ITEM_ID_LEN}) AS itemId,
  CAST(CASE WHEN kind = 'add' THEN q WHEN kind = 'restock' THEN {syn.RESTOCK_AMOUNT} END AS INTEGER) AS quantity
FROM c"""


@register("synth_power_law", _synth_sql())
def q_synth_power_law(spark, sf_dir):
    """One synthetic request per driver event (power-law users/items)."""
    return syn.events(_events(spark, sf_dir), "event_id", P.SYN_USERS, P.SYN_ITEMS, P.SYN_POWER_A)


@register("cart_positions", None)
def q_cart_positions(spark, sf_dir):
    """Position of each add in its user's cart cycle."""
    return carts.cart_positions(_domain(spark, sf_dir, P.UNIT, ("add", "checkout")))


CART_POS_SQL = f"""WITH d AS ({td.domain_events_sql(3, ("add", "checkout"))}),
cn AS (SELECT *, CAST(COALESCE(SUM(CASE WHEN kind = 'checkout' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cart_no
  FROM d WHERE user_id IS NOT NULL)
SELECT user_id, event_id, cart_no,
  CAST(row_number() OVER (PARTITION BY user_id, cart_no ORDER BY ts, event_id) AS BIGINT) AS position
FROM cn WHERE kind = 'add'"""
ORACLES["cart_positions"] = CART_POS_SQL


@register("progress_marks", """WITH o AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS position FROM events)
SELECT event_id, position FROM o WHERE position % 1000 = 0""")
def q_progress_marks(spark, sf_dir):
    """Every 1000th event with its running count."""
    e = _events(spark, sf_dir).select("event_id", "ts")
    return keyed.every_nth(e, 1000).select("event_id", "position")


# ---------------------------------------------------------------- streaming
@register("stream_receipts", ORACLES["receipts_clear"])
def q_stream_receipts(spark, sf_dir):
    """The two-stage stateful stream over the events in one run."""
    from keyfold.streaming.replay import stream_receipts

    return stream_receipts(spark, sf_dir, P.UNIT, waves=1)


@register("stream_resume", ORACLES["receipts_clear"])
def q_stream_resume(spark, sf_dir):
    """Three ordered waves, the query stopped and restarted on the same
    checkpoint between waves; equals the uninterrupted batch result."""
    from keyfold.streaming.replay import stream_receipts

    return stream_receipts(spark, sf_dir, P.UNIT, waves=3)


def _series_sql() -> str:
    lbl = "CASE run " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.RUN_LABELS.items()) + " ELSE 'other' END"
    parts = []
    for stat, expr in (("max", "CAST(max(latency) AS DOUBLE)"), ("p99", "quantile_cont(latency, 0.99)"),
                       ("p50", "quantile_cont(latency, 0.5)"), ("min", "CAST(min(latency) AS DOUBLE)"),
                       ("count", "CAST(count(*) AS DOUBLE)")):
        label = (f"'count for ' || {lbl}" if stat == "count" else f"'{stat} latency  ' || {lbl}")
        parts.append(f"SELECT run, '{stat}' AS stat, {expr} AS value, 'benchmark.' || {lbl} || '.{stat}' AS metric, "
                     f"{label} AS label FROM lf GROUP BY run")
    return LF_SQL + "\nUNION ALL\n".join(parts)


@register("latency_series", _series_sql())
def q_latency_series(spark, sf_dir):
    """Dashboard stats per run in long form with series labels."""
    return lat.latency_series(_rows(spark, sf_dir), P.RUN_LABELS)


@register("stream_receipt_lines", ORACLES["receipt_lines"])
def q_stream_receipt_lines(spark, sf_dir):
    """The stream with a map-state basket; per-item receipts."""
    from keyfold.streaming.replay import stream_receipt_lines

    return stream_receipt_lines(spark, sf_dir, P.UNIT, waves=2)


@register("stream_out_of_order", ORACLES["receipts_clear"])
def q_stream_out_of_order(spark, sf_dir):
    """Ordered streaming mode (watermark + buffered state): events arrive in
    reverse half-month order, receipts still equal the batch result."""
    from keyfold.streaming.replay import stream_receipts_out_of_order

    return stream_receipts_out_of_order(spark, sf_dir, P.UNIT)


# ------------------------------------------------- variants, each as it stands
@register("echo_confirms", f"""SELECT {_U} AS "userId", {_ITEM} AS "itemId", {_Q} AS quantity,
  CAST((epoch_us(ts) // 1000) AS VARCHAR) AS "publishTimestamp", event_id
FROM events WHERE event_type IN ('click','view')""")
def q_echo_confirms(spark, sf_dir):
    """The simple variant echoes every add at once with its raw quantity."""
    out = carts.echo_confirms(_domain(spark, sf_dir, P.SIMPLE, ("add",)))
    return out.select("userId", "itemId", "quantity", "publishTimestamp", "event_id")


@register("receipts_embedded", _cart_sql(P.EMBEDDED, RECEIPT_CLEAR_SELECT))
def q_receipts_embedded(spark, sf_dir):
    """The embedded variant as it is (unit demand, restocks ignored)."""
    return _receipts(spark, sf_dir, P.EMBEDDED)


@register("confirms_remote", _settled_sql(P.ANY, CONFIRM_SELECT))
def q_confirms_remote(spark, sf_dir):
    """The remote variant's confirmations carry the real quantity."""
    return carts.add_confirms(_settled(spark, sf_dir, P.ANY))


def _topic_sql(profile, receipts_select: str) -> str:
    stamp = "CAST((epoch_us(ts) // 1000) AS VARCHAR)"
    receipts = receipts_select.replace("SELECT user_id, event_id, running", "SELECT user_id, event_id, ts, running")
    return _cart_sql(profile, f"""SELECT 'add-confirm' AS topic, CAST(user_id AS VARCHAR) AS "key",
  '{{"userId":"' || user_id || '","itemId":"' || item_id || '"'
  || CASE WHEN requested <> 0 THEN ',"quantity":' || requested ELSE '' END
  || ',"publishTimestamp":"' || {stamp} || '"}}' AS value
FROM settled WHERE kind = 'add' AND user_id IS NOT NULL
UNION ALL
SELECT '{profile.receipt_topic}', CAST(user_id AS VARCHAR),
  '{{"userId":"' || user_id || '","receipt":"' || receipt || '","publishTimestamp":"' || "publishTimestamp" || '"}}'
FROM ({receipts}) r""")


@register("topic_records", _topic_sql(P.ANY, RECEIPT_RUNNING_SELECT))
def q_topic_records(spark, sf_dir):
    """Confirmations and receipts as topic records (remote)."""
    from keyfold.streaming.pipeline import to_topic_records

    settled = _settled(spark, sf_dir, P.ANY)
    adds = settled.where((F.col("kind") == "add") & F.col("user_id").isNotNull())
    confirms = carts.add_confirms(adds).select(
        F.lit("confirm").alias("kind"), F.col("userId").cast("long").alias("user_id"),
        F.col("itemId").cast("long").alias("item_id"), "quantity", F.lit(None).cast("string").alias("receipt"),
        "publishTimestamp",
    )
    receipts = carts.receipts(settled, _domain(spark, sf_dir, P.ANY, ("checkout",)), P.ANY).select(
        F.lit("receipt").alias("kind"), "user_id", F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("int").alias("quantity"), "receipt", "publishTimestamp",
    )
    records = to_topic_records(confirms.unionByName(receipts), P.ANY)
    return records.withColumn("key", F.decode("key", "UTF-8"))


# --------------------------------------------------------------- more decoding
@register("decode_checkouts", f"""SELECT {_U} AS key, {_U} AS "userId", {_STAMP} AS "publishTimestamp"
FROM events WHERE event_type = 'purchase'""")
def q_decode_checkouts(spark, sf_dir):
    """P2."""
    dec = routing.decode(routing.route(_lines(spark, sf_dir)))
    return routing.accepted(dec, "checkout").select("key", "userId", "publishTimestamp")


@register("decode_restocks", f"""SELECT {_ITEM} AS key, {_ITEM} AS "itemId", CAST(300 AS INTEGER) AS quantity,
  {_STAMP} AS "publishTimestamp" FROM events WHERE event_type = 'signup'""")
def q_decode_restocks(spark, sf_dir):
    """P3."""
    dec = routing.decode(routing.route(_lines(spark, sf_dir)))
    return routing.accepted(dec, "restock").select("key", "itemId", "quantity", "publishTimestamp")


# JSON texts of a quantity by event_id % 10, and what each decodes to (NULL: rejected).
_QUANTITY_FORMS = [
    ('"4"', 4), ("3.0", 3), ("3.5", None), ("99999999999", None), ("abc", None),
    ('"x"', None), ("null", 0), ("[1]", None), ("2147483647", 2147483647), ("1e2", 100),
]


def _forms_sql(column: int) -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {lit(f[column])}" for i, f in enumerate(_QUANTITY_FORMS)) + " END"


@register("decode_variants", f"""SELECT event_id,
  event_id % 7 <> 0 AND (event_id % 3 = 0 OR {_forms_sql(1)} IS NOT NULL) AS decoded,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE COALESCE({_forms_sql(1)}, 0) END AS INTEGER) AS quantity,
  {_U} AS "userId" FROM events WHERE event_type IN ('click','view') AND event_id % 10 <> 4
UNION ALL SELECT event_id, event_id % 3 = 0 AND event_id % 7 <> 0, CAST(0 AS INTEGER),
  CASE WHEN event_id % 3 = 0 THEN {_U} END
FROM events WHERE event_type IN ('click','view') AND event_id % 10 = 4""")
def q_decode_variants(spark, sf_dir):
    """Quoted, fractional, too large, malformed and absent quantities,
    absent item ids, and (every 7th) a field that the message does not declare."""
    adds = _events(spark, sf_dir).where(F.col("event_type").isin(*td.ADD_TYPES))
    form = F.element_at(F.array(*[F.lit(f[0]) for f in _QUANTITY_FORMS]), (F.col("event_id") % 10).cast("int") + 1)
    quantity = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(',"quantity":'), form))
    extra = F.when(F.col("event_id") % 7 == 0, ',"quantityUnit":1').otherwise("")
    user = F.col("user_id").cast("string")
    body = F.concat(F.lit('{"userId":"'), user, F.lit('"'), quantity, extra, F.lit("}"))
    lines = adds.select("event_id", F.lit("add-to-cart").alias("topic"), body.alias("body"))
    return routing.decode(lines).select("event_id", "decoded", "quantity", "userId")


@register("poison_kinds", """WITH t AS (SELECT event_id, event_type,
  CASE WHEN event_id % 11 = 0 THEN -1 ELSE 2 END AS q, CASE WHEN event_id % 13 = 0 THEN '' ELSE props END AS message FROM events)
SELECT event_id, CASE WHEN event_type IN ('click','view') AND q < 0 THEN 'negative_quantity'
  WHEN message = '' THEN 'empty_message' ELSE 'unknown_type' END AS reason
FROM t WHERE (event_type IN ('click','view') AND q < 0) OR message = '' OR event_type = 'error'""")
def q_poison_kinds(spark, sf_dir):
    """negative quantity, empty message, unknown type."""
    et = F.col("event_type")
    topic = (
        F.when(et.isin(*td.ADD_TYPES), "add-to-cart").when(et.isin(*td.CHECKOUT_TYPES), "checkout")
        .when(et.isin(*td.RESTOCK_TYPES), "restock").otherwise("no-such-topic")
    )
    records = _events(spark, sf_dir).select(
        "event_id", topic.alias("topic"), F.lit(True).alias("decoded"),
        F.when(F.col("event_id") % 11 == 0, -1).otherwise(2).alias("quantity"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("props")).alias("message"),
    )
    return routing.quarantine(records, "message").select("event_id", "reason")


# ------------------------------------------------------------- logs as files
@register("latency_log_round_trip", f"""SELECT CAST(event_id % {P.N_RUNS} AS BIGINT) AS run,
  CAST((epoch_us(ts) // 1000) AS VARCHAR) AS "inputKafkaTimestamp",
  (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) AS "outputKafkaTimestamp" FROM events""")
def q_latency_log_round_trip(spark, sf_dir):
    """JSON lines written per run, one record of each cut off, read back."""
    from keyfold.session import shared_path

    path = shared_path(spark, "latency-log")
    log = latencylog.from_events(_events(spark, sf_dir), P.N_RUNS)
    latencylog.write_json(log, path)
    cut = log.select("run").distinct().select("run", F.lit('{"inputKafkaTimestamp":"17040').alias("value"))
    cut.write.mode("append").partitionBy("run").text(path)
    return latencylog.read_json(spark, path).select(F.col("run").cast("long").alias("run"), "inputKafkaTimestamp", "outputKafkaTimestamp")


@register("period_log_round_trip", f"""SELECT CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
  {_KEY_SQL} || '=' || ({_BODY_SQL}) AS value FROM events""")
def q_period_log_round_trip(spark, sf_dir):
    """The text log written one folder a period, and read back."""
    from keyfold.session import shared_path

    path = shared_path(spark, "period-log")
    eventlog.write_periods(_lines(spark, sf_dir), path)
    return eventlog.read_periods(spark, path).select(F.col("period").cast("int").alias("period"), "value")


@register("forward_fill", """WITH r AS (SELECT event_id % 3 AS part, event_id, (epoch_us(ts) // 1000) AS ms, floor(value) AS late,
  CASE WHEN event_type <> 'error' THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) END AS i FROM events),
f AS (SELECT last_value(i IGNORE NULLS) OVER (PARTITION BY part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS "inputKafkaTimestamp", CAST(ms + late AS BIGINT) AS "outputKafkaTimestamp" FROM r)
SELECT * FROM f WHERE "inputKafkaTimestamp" IS NOT NULL""")
def q_forward_fill(spark, sf_dir):
    """A record that does not parse takes the input time of the one before."""
    from keyfold.functions.timefns import epoch_ms

    ms = epoch_ms("ts")
    value = F.when(
        F.col("event_type") != "error", F.to_json(F.struct(ms.cast("string").alias("publishTimestamp")))
    ).otherwise('{"publishTimestamp":')
    raw = _events(spark, sf_dir).select(
        (F.col("event_id") % 3).alias("partition"), F.col("event_id").alias("offset"), value.alias("value"),
        (ms + F.floor("value")).cast("long").alias("timestamp"),
    )
    return latencylog.forward_fill_failed(raw)


@register("endless_replay", f"""SELECT event_id, CAST(r AS INTEGER) AS round,
  (epoch_us(ts) // 1000) + r * {P.REPLAY_PERIOD_MS} AS ts_ms
FROM events, (SELECT unnest(range(0, {P.REPLAY_ROUNDS})) AS r)""")
def q_endless_replay(spark, sf_dir):
    """The data set again and again, each round shifted in time."""
    from keyfold.functions.timefns import epoch_ms

    e = _events(spark, sf_dir).select("event_id", epoch_ms("ts").alias("ts_ms"))
    return syn.endless_replay(e, P.REPLAY_ROUNDS, P.REPLAY_PERIOD_MS).select("event_id", "round", "ts_ms")


# ---------------------------------------------------------- latency, completed
@register("view_range", LF_SQL + f"""SELECT run, start_bucket, avg(latency) AS mean_latency, count(*) AS n_events
FROM lf WHERE start_bucket BETWEEN {P.VIEW_LO} AND {P.VIEW_HI} GROUP BY run, start_bucket""")
def q_view_range(spark, sf_dir):
    """the part of the latency plot that is shown."""
    per_bucket = lat.latency_by_start_bucket(_lf(spark, sf_dir))
    return lat.view_range(per_bucket, "start_bucket", P.VIEW_LO, P.VIEW_HI)


@register("gap_filled_full", LF_SQL + """, c AS (SELECT run, end_bucket, count(*) AS n FROM lf GROUP BY run, end_bucket),
sp AS (SELECT r.run, CAST(unnest(range(m.lo, m.xm + 1)) AS BIGINT) AS end_bucket
       FROM (SELECT DISTINCT run FROM lf) r, (SELECT max(end_bucket) AS xm, least(0, min(end_bucket)) AS lo FROM lf) m)
SELECT sp.run, sp.end_bucket, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_events
FROM sp LEFT JOIN c ON sp.run = c.run AND sp.end_bucket = c.end_bucket""")
def q_gap_filled_full(spark, sf_dir):
    """J4 with the last and any negative buckets: no event is lost."""
    return lat.throughput_gap_filled(_lf(spark, sf_dir), include_last=True)


# ------------------------------------------------------------ baskets, carts
_SIGNED = "CASE WHEN event_type = 'view' THEN -CAST(1 + event_id % 9 AS BIGINT) ELSE CAST(1 + event_id % 9 AS BIGINT) END"


@register("baskets_with_removals", f"""WITH RECURSIVE r AS (SELECT user_id,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_id, {_SIGNED} AS d,
    row_number() OVER (PARTITION BY user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click','view')),
f AS (SELECT user_id, item_id, event_id, rn, greatest(d, 0) AS q FROM r WHERE rn = 1
  UNION ALL SELECT r.user_id, r.item_id, r.event_id, r.rn, greatest(f.q + r.d, 0)
  FROM f JOIN r ON f.user_id = r.user_id AND f.item_id = r.item_id AND r.rn = f.rn + 1)
SELECT user_id, item_id, event_id, CAST(q AS BIGINT) AS basket_qty FROM f""")
def q_baskets_with_removals(spark, sf_dir):
    """A3: clicks add, views remove; an entry that would drop to 0 is removed."""
    d = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).select(
        "event_id", "ts", "user_id", td.item_col().alias("item_id"),
        F.when(F.col("event_type") == "view", -td.raw_add_quantity()).otherwise(td.raw_add_quantity()).alias("quantity"),
    )
    return carts.basket_with_removals(d).select("user_id", "item_id", "event_id", F.col("basket_qty").cast("long").alias("basket_qty"))


@register("basket_maps", _cart_sql(P.UNIT, BASKET_ITEMS_SELECT))
def q_basket_maps(spark, sf_dir):
    """A4: each cart's basket as one map, its entries listed again."""
    maps = carts.basket_maps(q_basket_items(spark, sf_dir))
    return maps.select("user_id", "cart_no", F.explode("basket").alias("item_id", "quantity"))


def _cycles_sql() -> str:
    row = "(cart || '/' || step)"
    def power(expr, n, seed):
        return f"CAST(floor(pow({R.uniform_sql(expr, seed)}, 1.0 / {P.SYN_POWER_A}) * {n}) AS BIGINT)"

    return f"""WITH c AS (SELECT event_id AS cart, {power('event_id', 1000, 11)} AS user_idx,
  CAST(floor({R.uniform_sql('event_id', 12)} * {syn.MAX_ADDS - 1}) + 2 AS BIGINT) AS adds FROM events),
s AS (SELECT *, unnest(range(1, adds + 2)) AS step FROM c)
SELECT cart, CAST(step AS BIGINT) AS step, CASE WHEN step <= adds THEN 'add' ELSE 'checkout' END AS kind, user_idx,
  CASE WHEN step <= adds THEN {power(row, P.SYN_ITEMS, 13)} END AS item_idx,
  CAST(CASE WHEN step <= adds THEN floor({R.uniform_sql(row, 14)} * {syn.MAX_QUANTITY}) + 1 END AS INTEGER) AS quantity FROM s"""


@register("synth_cart_cycles", _cycles_sql())
def q_synth_cart_cycles(spark, sf_dir):
    """One whole cart per driver event: its adds, then the checkout."""
    return syn.cart_cycles(_events(spark, sf_dir), "event_id", 1000, P.SYN_ITEMS, P.SYN_POWER_A)


# --------------------------------------------------------------- more streams
@register("stream_receipts_running", ORACLES["receipts_running"])
def q_stream_receipts_running(spark, sf_dir):
    """The remote variant streamed: real quantities, running receipts."""
    from keyfold.streaming.replay import stream_receipts

    return stream_receipts(spark, sf_dir, P.ANY)


@register("stream_from_log", ORACLES["receipts_embedded"])
def q_stream_from_log(spark, sf_dir):
    """Text log lines routed, decoded and settled in one stream."""
    from keyfold.streaming.replay import stream_receipts_from_log

    return stream_receipts_from_log(spark, sf_dir, P.EMBEDDED)


def _poisoned(sql: str) -> str:
    """The oracle over events whose first add of the fail period asks for -1."""
    first = (f"(SELECT arg_min(event_id, ts) FROM events WHERE event_type IN ('click','view') "
             f"AND datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) = {P.FAIL_PERIOD})")
    plain = "THEN CAST(1 + event_id % 9 AS INTEGER)"
    return sql.replace(plain, f"THEN CASE WHEN event_id = {first} THEN -1 ELSE CAST(1 + event_id % 9 AS INTEGER) END")


@register("stream_crash_resume", _poisoned(ORACLES["receipts_embedded"]))
def q_stream_crash_resume(spark, sf_dir):
    """A crash inside a micro-batch on a poison record, then a restart."""
    from keyfold.streaming.replay import stream_crash_resume

    return stream_crash_resume(spark, sf_dir, P.EMBEDDED, P.FAIL_PERIOD)


@register("state_final_stock", _settled_sql(P.UNIT, "SELECT item_id, final_stock FROM (" + OUTCOME_SELECT + ") o"))
def q_state_final_stock(spark, sf_dir):
    """Final stock per item read from the stream's state."""
    from keyfold.streaming.replay import state_final_stock

    return state_final_stock(spark, sf_dir, P.UNIT)


@register("live_buckets", f"""SELECT CAST(event_id % {P.N_RUNS} AS BIGINT) AS run,
  CAST((epoch_us(ts) // 3600000000) * 3600000 AS BIGINT) AS bucket_ms, count(*) AS n_events,
  avg(CAST(floor(value) AS BIGINT)) AS mean_latency FROM events GROUP BY 1, 2""")
def q_live_buckets(spark, sf_dir):
    """Windows closed by a watermark in append mode."""
    from keyfold.streaming import extras

    out = _live(spark, sf_dir, extras.live_buckets)
    return out.select("run", F.unix_millis("bucket_start").alias("bucket_ms"), "n_events", "mean_latency")


def _live(spark, sf_dir, build):
    """The rows that a live aggregate over the latency log has let go; a tick
    beyond the log's end and its lateness bound closes the last window."""
    from keyfold.session import shared_path
    from keyfold.streaming.pipeline import run_available, stream_session

    base = shared_path(spark, "live")
    log = latencylog.from_events(_events(spark, sf_dir), P.N_RUNS)
    tick = log.groupBy().agg(F.max(F.col("inputKafkaTimestamp").cast("long")).alias("t")).where("t IS NOT NULL").select(
        F.lit(-1).cast("long").alias("run"), (F.col("t") + 86_400_000 * 60).cast("string").alias("inputKafkaTimestamp"),
        (F.col("t") + 86_400_000 * 60).alias("outputKafkaTimestamp"),
    )
    session = stream_session(spark)
    for part in (log, tick):
        part.write.mode("append").parquet(f"{base}/in")
        stream = session.readStream.schema(log.schema).parquet(f"{base}/in")
        run_available(build(stream, P.LIVE_WINDOW, P.LIVE_LATENESS), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").where("run >= 0")


@register("live_percentiles", f"""SELECT CAST(event_id % {P.N_RUNS} AS BIGINT) AS run,
  CAST((epoch_us(ts) // 3600000000) * 3600000 AS BIGINT) AS bucket_ms, count(*) AS n_events, true AS p50_ok, true AS p99_ok
FROM events GROUP BY 1, 2""")
def q_live_percentiles(spark, sf_dir):
    """Live percentiles from sketches; per window, whether the exact
    ranks of the reported values are within the stated error (twice, for the
    one case in a hundred)."""
    from keyfold.streaming import extras

    live = _live(spark, sf_dir, extras.live_percentiles).select(
        "run", F.unix_millis("bucket_start").alias("bucket_ms"), "n_events", "p50", "p99")
    rows = lat.latency_rows(latencylog.from_events(_events(spark, sf_dir), P.N_RUNS)).select(
        "run", (F.floor(F.col("in_ms") / 3_600_000) * 3_600_000).alias("bucket_ms"), "latency")
    error = 2 * extras.KLL_RANK_ERROR

    def ok(p: str, q: float):
        below, upto = F.avg((F.col("latency") < F.col(p)).cast("int")), F.avg((F.col("latency") <= F.col(p)).cast("int"))
        return ((below <= q + error) & (upto >= q - error)).alias(f"{p}_ok")

    return live.join(rows, ["run", "bucket_ms"]).groupBy("run", "bucket_ms", "n_events").agg(ok("p50", 0.5), ok("p99", 0.99))


@register("live_gap_filled", ORACLES["gap_filled_full"])
def q_live_gap_filled(spark, sf_dir):
    """The gap-filled counts as the stream lets them go bucket by
    bucket, up to the log's last bucket (the tick behind it lets go more)."""
    from keyfold.streaming import extras

    origins = lat.run_origins(latencylog.from_events(_events(spark, sf_dir), P.N_RUNS)).collect()  # one row per run
    bases = [(r["run"], r["t0"] - P.RUN_SHIFTS.get(r["run"], 0) * P.BUCKET_MS) for r in origins if r["t0"] is not None]

    def build(stream, _window, lateness):
        return extras.live_gap_filled(stream, stream.sparkSession.createDataFrame(bases, "run long, base long"), P.BUCKET_MS, lateness)

    rows = _live(spark, sf_dir, build)
    last = rows.where("n_events > 0").agg(F.max("end_bucket")).first()[0]  # of what the stream has written
    return rows.where(F.col("end_bucket") <= F.lit(last).cast("long"))


@register("state_by_wave", _settled_sql(P.UNIT, f"""SELECT CAST(w.wave AS INTEGER) AS wave, item_id,
  CAST(arg_max(stock_after, rn) AS BIGINT) AS stock
FROM settled, (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM ({td.domain_events_sql(P.UNIT.restock_qty)}) d),
  (SELECT unnest(range(0, {P.STATE_WAVES})) AS wave) w
WHERE (epoch_us(ts) // 1000) < lo + (hi - lo + 1) * (w.wave + 1) // {P.STATE_WAVES} GROUP BY w.wave, item_id"""))
def q_state_by_wave(spark, sf_dir):
    """Each item's stock after each wave, from the state at that epoch."""
    from keyfold.streaming.replay import state_by_wave

    return state_by_wave(spark, sf_dir, P.UNIT, P.STATE_WAVES)


@register("stream_topic_records", ORACLES["topic_records"])
def q_stream_topic_records(spark, sf_dir):
    """Topic records leave the stream exactly once, over two crashes."""
    from keyfold.streaming.replay import stream_topic_records

    return stream_topic_records(spark, sf_dir, P.ANY, P.N_FILLER).withColumn("key", F.decode("key", "UTF-8"))


@register("stream_latency_log", _settled_sql(P.UNIT, f"""SELECT CAST(0 AS BIGINT) AS run,
  CAST((ms - (SELECT min(epoch_us(ts) // 1000) FROM settled WHERE kind = 'add' AND user_id IS NOT NULL)) // {P.BUCKET_MS} AS BIGINT) AS start_bucket,
  count(*) AS n_events, true AS later
FROM (SELECT epoch_us(ts) // 1000 AS ms FROM settled WHERE kind = 'add' AND user_id IS NOT NULL) GROUP BY 1, 2"""))
def q_stream_latency_log(spark, sf_dir):
    """The stream's confirmations become a latency log, which the
    evaluator reads: events per start bucket, all confirmed after they came in."""
    from keyfold.streaming.replay import stream_latency_log

    log = stream_latency_log(spark, sf_dir, P.UNIT).withColumn("run", F.lit(0).cast("long"))
    per_bucket = lat.latency_by_start_bucket(lat.latency_frame(log, P.BUCKET_MS))
    return per_bucket.select("run", "start_bucket", "n_events", (F.col("mean_latency") > 0).alias("later"))


@register("stream_envelope", f"""SELECT event_id, CASE WHEN kind = 'add' THEN 'add-to-cart' WHEN kind = 'checkout' THEN 'checkout' ELSE 'restock-item' END AS typename,
  CAST(user_id AS VARCHAR) AS "userId", CAST(item_id AS VARCHAR) AS "itemId", quantity, CAST(ts_ms AS VARCHAR) AS "publishTimestamp"
FROM ({td.domain_events_sql(P.UNIT.restock_qty)}) d""")
def q_stream_envelope(spark, sf_dir):
    """Messages of three types in one stream of typed VARIANT envelopes,
    each unpacked by its own function's fields."""
    from keyfold.streaming.replay import stream_envelope

    return stream_envelope(spark, sf_dir, P.UNIT)
