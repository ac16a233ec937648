"""Stateful processors for the two-stage streaming chain.

Stage 1 is keyed by item (stock), stage 2 by user (basket).  The request /
reply cycle of the reference becomes a chain: settled adds carry their user
to stage 2 (J2), checkouts join the stream before stage 2.  A handler is given
its key's rows of the micro-batch in ``(ts, event_id)`` order, as a series of
Arrow chunks (``pipeline.in_order``: Spark sorts each partition, on disk where
it must), and folds chunk by chunk with the state carried along.  Memory is one
chunk, however many rows a hot key has.  The result equals the batch plan when
micro-batches arrive in order.

State per key is a few ValueStates in the RocksDB store; it is checkpointed
with every batch, so a restart on the same checkpoint resumes exactly.

Spark's Python side walks a processor's rows one by one, and each call on a
state is a message to the JVM.  ``Packed`` lets a processor run at the cost of
its chunks: rows come and go as Arrow messages of many rows, and the map states
of a shard of users are read and written as one value each.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keyfold.operators.reserve import settle_run


SETTLED_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("requested", T.IntegerType()),
        T.StructField("restock", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("stock_after", T.LongType()),
    ]
)

OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("receipt", T.StringType()),
        T.StructField("publishTimestamp", T.StringType()),
    ]
)

ITEM_RECEIPT_SCHEMA = T.StructType([OUTPUT_SCHEMA["user_id"], OUTPUT_SCHEMA["event_id"], OUTPUT_SCHEMA["receipt"]])


def us(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").to_numpy().astype("int64")


def _chunks(rows: Iterator[pd.DataFrame], by: str | None = None) -> Iterator[pd.DataFrame]:
    """The key's chunks, held against the order they must come in (``by``: a
    column that goes before the time)."""
    last = None
    for pdf in rows:
        if not len(pdf):
            continue
        ts, ids = us(pdf["ts"]), pdf["event_id"].to_numpy(dtype=np.int64)
        first = pdf[by].to_numpy(dtype=np.int64) if by else np.zeros(len(pdf), np.int64)
        before = (ts[:-1] < ts[1:]) | ((ts[:-1] == ts[1:]) & (ids[:-1] <= ids[1:]))
        before = (first[:-1] < first[1:]) | ((first[:-1] == first[1:]) & before)
        if not before.all() or last is not None and last > (first[0], ts[0], ids[0]):
            raise RuntimeError("rows of a key out of (ts, event_id) order")
        last = (first[-1], ts[-1], ids[-1])
        yield pdf.reset_index(drop=True)


def _none(x) -> bool:
    """Is a value of a nullable column, as pandas holds it, missing?"""
    return x is None or x is pd.NA or x != x


def _long(x) -> int | None:
    return None if _none(x) else int(x)


def _text(x) -> str | None:
    return None if _none(x) else str(int(x))


def _nullable_long(values) -> pd.Series:
    return pd.Series(pd.array(values, dtype="Int64"))


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.TimestampNTZType(): pa.timestamp("us")}
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType]) for f in schema.fields])


def pack(key: str, given: pa.Schema):
    """For ``mapInArrow`` over rows in the order of ``key``: a row per run of
    equal keys in an Arrow batch, with the run's rows as one message.  ``seq``
    counts up within a task, so it keeps the order of a key's messages."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            held = keys.to_numpy(zero_copy_only=False)
            first = np.append(0, np.flatnonzero(held[1:] != held[:-1]) + 1)
            rows = pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(given.names, given.types)], schema=given)
            bodies = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(first, [*first[1:], len(held)])]
            at = pa.array(np.arange(seq, seq + len(first), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first)), at, pa.array(bodies, pa.binary())], [key, "seq", "rows"])
            seq += len(first)

    return packed


def unpack(made: pa.Schema):
    """For ``mapInArrow``: the rows of the messages that ``Packed`` emits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [pa.ipc.read_record_batch(pa.py_buffer(m.as_py()), made) for m in batch.column(0)]
            yield from pa.Table.from_batches(held, made).combine_chunks().to_batches(max_chunksize=10_000)

    return rows


class _Entries:
    """A map state of one key, held as one value of it: read at the first use in
    a call, written at the call's end if it changed."""

    def __init__(self, value, key_schema: str, value_schema: str):
        types = {"long": pa.int64(), "string": pa.string()}
        self.schema = pa.schema([(n, types[t]) for n, t in (key_schema.split(), value_schema.split())])
        self.value, self.held, self.changed = value, None, False

    def _all(self) -> dict:
        if self.held is None:
            message = self.value.get()
            self.held = {}
            if message is not None:
                batch = pa.ipc.read_record_batch(pa.py_buffer(bytes(message[0])), self.schema)
                self.held = dict(zip(*(c.to_pylist() for c in batch.columns)))
        return self.held

    def getValue(self, key: tuple) -> tuple | None:
        held = self._all()
        return (held[key[0]],) if key[0] in held else None

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self._all()

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._all()[key[0]] = value[0]
        self.changed = True

    def removeKey(self, key: tuple) -> None:
        self.changed |= self._all().pop(key[0], None) is not None

    def save(self) -> None:
        if self.changed and self.held:
            columns = zip((list(self.held), list(self.held.values())), self.schema.types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=self.schema)
            self.value.update((batch.serialize().to_pybytes(),))
        elif self.changed:
            self.value.clear()
        self.held, self.changed = None, False


class _EntriesHandle:
    """A handle whose map states are ``_Entries``."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.maps = handle, []

    def getValueState(self, name: str, schema: str):
        return self.handle.getValueState(name, schema)

    def getMapState(self, name: str, key_schema: str, value_schema: str) -> _Entries:
        self.maps.append(_Entries(self.handle.getValueState(name, "entries binary"), key_schema, value_schema))
        return self.maps[-1]


class Packed(StatefulProcessor):
    """``inner`` over packed rows (``pack``), whose output is packed too
    (``unpack``).  ``given`` and ``made`` are the rows' schemas."""

    def __init__(self, inner: StatefulProcessor, given: pa.Schema, made: pa.Schema):
        self.inner, self.given, self.made = inner, given, made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = _EntriesHandle(handle)
        self.inner.init(self.states)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        messages = (m for pdf in rows for m in pdf["rows"])
        chunks = (
            pa.ipc.read_record_batch(pa.py_buffer(bytes(m)), self.given).to_pandas(types_mapper=_NULLABLE.get) for m in messages
        )
        for pdf in self.inner.handleInputRows(key, chunks, timerValues):
            batch = pa.RecordBatch.from_pandas(pdf, self.made, preserve_index=False)
            yield pd.DataFrame({"rows": [batch.serialize().to_pybytes()]})
        for state in self.states.maps:
            state.save()

    def close(self) -> None:
        self.inner.close()


class StockProcessor(StatefulProcessor):
    """X1/X2 stock function: all-or-nothing reservation."""

    def __init__(self, initial_stock: int, restock_applies: bool):
        self.initial_stock = int(initial_stock)
        self.restock_applies = bool(restock_applies)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "stock long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.stock.get()
        s = self.initial_stock if held is None else int(held[0])
        for pdf in _chunks(rows):
            is_add = (pdf["kind"] == "add").to_numpy(dtype=bool)
            restock = pdf["restock"].fillna(0).to_numpy(dtype=np.int64) * self.restock_applies
            delta = np.where(is_add, -pdf["requested"].fillna(0).to_numpy(dtype=np.int64), restock)
            ok, after = settle_run(s, delta, is_add)
            status = np.where(is_add, np.where(ok, "INSTOCK", "OUTOFSTOCK"), None)
            s = int(after[-1])
            yield pd.DataFrame(
                {
                    "event_id": pdf["event_id"].astype("int64"),
                    "ts": pdf["ts"],
                    "ts_ms": pdf["ts_ms"].astype("int64"),
                    "kind": pdf["kind"],
                    "user_id": _nullable_long(pdf["user_id"]),
                    "item_id": _nullable_long(pdf["item_id"]),
                    "requested": pd.array(pdf["requested"], dtype="Int32"),
                    "restock": pd.array(pdf["restock"], dtype="Int32"),
                    "status": status,
                    "stock_after": after,
                }
            )
        self.stock.update((s,))

    def close(self) -> None:
        pass


class _ByUser(StatefulProcessor):
    """The cart functions' frame: a key is a shard of users, its rows are in
    (user_id, ts, event_id) order, and each user's state is an entry of the
    shard's map states.  A call's fixed cost (it is milliseconds, a hundred times
    that of a few rows) is thus paid per shard and micro-batch, not per user; a
    user that occurs costs one read, and one write if the state changed.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user, state, had = None, None, None
        for pdf in _chunks(rows, "user_id"):
            out: list[tuple] = []
            columns = (pdf[c].tolist() for c in ("user_id", "kind", "event_id", "item_id", "requested", "status", "ts_ms"))
            for u, kind, event_id, item, q, status, ts_ms in zip(*columns):
                if u != user:
                    if user is not None and state != had:
                        self.write(user, state)
                    user, had = u, self.read(u)
                    state = copy.copy(had)
                if kind == "add":
                    state = self.add(user, state, _long(event_id), _long(item), _long(q) or 0, status == "INSTOCK", ts_ms, out)
                elif kind == "checkout":
                    state = self.checked_out(user, state, _long(event_id), ts_ms, out)
            if out:
                yield pd.DataFrame(out, columns=self.columns, dtype=object)
        if user is not None and state != had:
            self.write(user, state)

    def close(self) -> None:
        pass


def _with_none(values: pd.Series, there: np.ndarray) -> np.ndarray:
    """The whole numbers of ``values``, None where ``there`` is false or no value is."""
    there = there & values.notna().to_numpy(dtype=bool)
    out = np.full(len(values), None, object)
    out[there] = values[there].to_numpy(dtype=np.int64).tolist()
    return out


class CartProcessor(_ByUser):
    """X1/X2 cart function: basket, confirmations and receipts.

    A chunk's baskets are running sums over stretches of rows: a user's rows, cut
    behind each checkout that clears.  Only users and receipts are walked.

    ``n_filler`` named states of 500 chars are set on a user's first add
    (T5/A19/P28, the state-size load of the reference); 0 by default.
    """

    columns = OUTPUT_SCHEMA.fieldNames()

    def __init__(self, checkout: str, receipt_format: str, n_filler: int = 0):
        self.checkout = checkout
        self.receipt_format = receipt_format
        self.n_filler = int(n_filler)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.basket = handle.getMapState("basket", "user_id long", "n long")
        self.fillers = [handle.getMapState(f"filler{i}", "user_id long", "v string") for i in range(self.n_filler)]
        self.filled = None  # the last user whose fillers are known to be set

    def read(self, user: int) -> int | None:
        held = self.basket.getValue((user,))
        return None if held is None else int(held[0])

    def write(self, user: int, b: int | None) -> None:
        if b is None:
            self.basket.removeKey((user,))
        else:
            self.basket.updateValue((user,), (b,))

    def _fill(self, user: int) -> None:
        self.filled = user
        for f in self.fillers:
            if not f.containsKey((user,)):
                f.updateValue((user,), ("a" * 500,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user, state, had = None, None, None
        for pdf in _chunks(rows, "user_id"):
            of = pdf["user_id"].to_numpy(dtype=np.int64)
            kind, status = (pdf[c].to_numpy(dtype=object) for c in ("kind", "status"))
            add, leaves = (kind == "add").astype(bool), (kind == "checkout").astype(bool)
            head = np.append(True, of[1:] != of[:-1])
            owner, first = np.cumsum(head) - 1, np.flatnonzero(head)
            users = of[first].tolist()
            if user != users[0]:
                if user is not None and state != had:
                    self.write(user, state)
                state = had = self.read(users[0])
            begin = [state, *map(self.read, users[1:])]
            if self.fillers:
                for u in np.unique(of[add]).tolist():
                    if self.filled != u:
                        self._fill(u)
            n, held = self._baskets(pdf, add & (status == "INSTOCK").astype(bool), leaves, head, owner, begin)
            end = np.append(first[1:], len(of)) - 1
            kept = held[end] & ~(leaves[end] & (self.checkout == "clear"))
            after = [b if k else None for b, k in zip(n[end].tolist(), kept.tolist())]
            for u, b, old in zip(users[:-1], after[:-1], [had, *begin[1:]]):
                if b != old:
                    self.write(u, b)
            user, state, had = users[-1], after[-1], had if len(users) == 1 else begin[-1]
            receipt = leaves & (held if self.checkout == "clear" else self.checkout == "running")
            out = self._rows(pdf, of, add, receipt, n)
            if len(out):
                yield out
        if user is not None and state != had:
            self.write(user, state)

    def _baskets(self, pdf, granted, leaves, head, owner, begin) -> tuple[np.ndarray, np.ndarray]:
        """Each row's basket, itself included but not yet cleared: its size, and
        whether there is one."""
        start = head.copy()
        if self.checkout == "clear":
            start[1:] |= leaves[:-1]
        at = np.flatnonzero(start)
        stretch = np.cumsum(start) - 1
        put = np.where(granted, pdf["requested"].fillna(0).to_numpy(dtype=np.int64), 0)
        total, times = np.cumsum(put), np.cumsum(granted)
        n = total - (total[at] - put[at])[stretch]
        held = times > (times[at] - granted[at])[stretch]
        carried = head[at][stretch]
        n += np.where(carried, np.array([b or 0 for b in begin], np.int64)[owner], 0)
        held |= carried & np.array([b is not None for b in begin])[owner]
        return n, held

    def _rows(self, pdf, of, add, receipt, n) -> pd.DataFrame:
        out = np.flatnonzero(add | receipt)
        pdf, add, receipt = pdf.iloc[out].reset_index(drop=True), add[out], receipt[out]
        size = _with_none(pd.Series(n[out]), receipt)
        text = np.full(len(out), None, object)
        text[receipt] = [
            self.receipt_format.replace("{user}", str(u)).replace("{n}", str(b)) for u, b in zip(of[out][receipt].tolist(), size[receipt])
        ]
        stamp = _with_none(pdf["ts_ms"], np.ones(len(out), bool))
        return pd.DataFrame(
            {
                "kind": np.where(add, "confirm", "receipt").astype(object),
                "user_id": of[out],
                "item_id": _with_none(pdf["item_id"], add),
                "event_id": pdf["event_id"].to_numpy(dtype=np.int64),
                "quantity": _with_none(pdf["requested"].fillna(0), add),
                "n_items": size,
                "receipt": text,
                "publishTimestamp": [None if t is None else str(t) for t in stamp],
            }
        )


class LatestMessageProcessor(StatefulProcessor):
    """Harness function (A18, F4, F5): keep the latest message per user in
    two named states; an empty message is a poison pill."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.m1 = handle.getValueState("message1", "v string")
        self.m2 = handle.getValueState("message2", "v string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for pdf in _chunks(rows):
            if (pdf["message"].isna() | (pdf["message"] == "")).any():
                raise RuntimeError(f"poison message for user {key[0]}")
            last, n = pdf["message"].iloc[-1], n + len(pdf)
        if last is not None:
            self.m1.update((last,))
            self.m2.update((last,))
        yield pd.DataFrame({"user_id": [str(key[0])], "latest_message": [last], "n_messages": [n]})

    def close(self) -> None:
        pass


class CartItemsProcessor(_ByUser):
    """T4 + P12 + X6: the basket as map state (user -> JSON of item and quantity,
    since a state's value cannot be a map); a checkout with a basket emits the
    per-item receipt (lines sorted by item) and clears the user's entry."""

    columns = ["user_id", "event_id", "receipt"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("basket_items", "user_id long", "items string")

    def read(self, user: int) -> dict[int, int]:
        held = self.items.getValue((user,))
        return {} if held is None else {int(k): v for k, v in json.loads(held[0]).items()}

    def write(self, user: int, items: dict[int, int]) -> None:
        if items:
            self.items.updateValue((user,), (json.dumps(items),))
        else:
            self.items.removeKey((user,))

    def add(self, user, items, event_id, item, q, granted, ts_ms, out) -> dict[int, int]:
        if granted:
            items[item] = items.get(item, 0) + q
        return items

    def checked_out(self, user, items, event_id, ts_ms, out) -> dict[int, int]:
        if items:
            lines = "".join(f"Item: {i}, Quantity: {q}\n" for i, q in sorted(items.items()))
            out.append((user, event_id, f"User {user} receipt: \n{lines}"))
        return {}


# ------------------------------------------------------------------ ordered mode
# Rows that arrive out of order wait in time buckets until the watermark has
# passed the bucket's end; rows older than the watermark are dropped by Spark as
# late, so a bucket that is let go is complete.  Opt-in (the reference is
# arrival-ordered); the lateness bound is the watermark delay.

DOMAIN_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
    ]
)
_DOMAIN_ARROW = arrow_schema(DOMAIN_SCHEMA)


class ReorderProcessor(StatefulProcessor):
    """T4/O2: one time bucket (and one of ``spread`` parts of it) per key.

    Each chunk of rows that arrives is appended to the bucket's list state as
    one Arrow message; the bucket's one timer reads the list once, emits it and
    clears it.  A row is thus written once and read once, whatever else waits.
    """

    def __init__(self, bucket_ms: int):
        self.bucket_ms = int(bucket_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            batch = pa.RecordBatch.from_pandas(pdf[_DOMAIN_ARROW.names], _DOMAIN_ARROW, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOMAIN_ARROW) as w:
                w.write_batch(batch)
            self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(key[0]) + 1) * self.bucket_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for (message,) in self.waiting.get():
            yield pa.ipc.open_stream(message).read_all().to_pandas(types_mapper=_NULLABLE.get)
        self.waiting.clear()

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ live spine


class SpineProcessor(StatefulProcessor):
    """J4 live: one row per elapsed bucket of a run, also where no event came.

    Input are counts of closed buckets, a row each; state is the next bucket to
    emit, and one timer stands at its end.  A count lets go the empty buckets
    before it; the timer lets go those that the watermark has passed since.
    Buckets start at 0, or at the run's first if that is earlier.
    """

    def __init__(self, bucket_ms: int):
        self.bucket_ms = int(bucket_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "bucket long")

    def _end(self, key, bucket: int) -> int:
        return int(key[1]) + (bucket + 1) * self.bucket_ms

    def _rows(self, key, first: int, counts: np.ndarray) -> pd.DataFrame:
        at = first + np.arange(len(counts), dtype=np.int64)
        return pd.DataFrame({"run": np.full(len(at), int(key[0]), np.int64), "end_bucket": at, "n_events": counts.astype(np.int64)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = pd.concat([pdf[["bucket", "n_events"]] for pdf in rows])  # a row per bucket, not per event
        start = int(self.next.get()[0]) if self.next.exists() else None
        first = min(0, int(closed["bucket"].min())) if start is None else start
        after = int(closed["bucket"].max()) + 1
        if int(closed["bucket"].min()) < first:
            raise RuntimeError("a bucket was closed after it had been let go")
        if start is not None:
            self.handle.deleteTimer(self._end(key, start))
        counts = np.zeros(after - first, np.int64)
        counts[closed["bucket"].to_numpy(dtype=np.int64) - first] = closed["n_events"].to_numpy(dtype=np.int64)
        self.next.update((after,))
        self.handle.registerTimer(self._end(key, after))
        yield self._rows(key, first, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first = int(self.next.get()[0])
        after = (int(timerValues.getCurrentWatermarkInMs()) - int(key[1])) // self.bucket_ms
        if after > first:
            self.next.update((after,))
            self.handle.registerTimer(self._end(key, after))
            yield self._rows(key, first, np.zeros(after - first, np.int64))

    def close(self) -> None:
        pass
