"""Message decode / encode as column expressions.

The reference parses each message with a JSON reader into a fixed schema and
writes it back with a printer that omits default-valued fields.  Here both
directions are ``from_json`` / ``to_json`` over declared structs, so they run
inside whole-stage codegen with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bytes_to_text(v) -> Column:
    """UTF-8 bytes (e.g. a Kafka value) to text."""
    return F.decode(_c(v), "UTF-8")


def key_bytes(k) -> Column:
    """A key as UTF-8 bytes."""
    return F.encode(_c(k).cast("string"), "UTF-8")


def split_key_line(line) -> tuple[Column, Column]:
    """``key=json`` line -> (key, body).

    The line is trimmed and split on ``=``; part 1 is the key and part 2 the
    body, as the replayer does (a later ``=`` would cut the body there too).
    A line with no ``=`` has a NULL body.
    """
    parts = F.split(F.trim(_c(line)), "=")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def parse_message(body) -> Column:
    """JSON object -> map of its fields as text; NULL if it is none.

    Parse once and read the fields from the map: see ``routing.decode``.
    """
    return F.from_json(_c(body), "map<string,string>")


def whole_number(text) -> Column:
    """The int that a JSON value spells (``4``, ``"4"``, ``4.0``, ``1e2``);
    NULL for anything else, and beyond 32 bits."""
    d = _c(text).try_cast("decimal(38,10)")
    fits = (d == F.floor(d)) & d.between(-(2**31), 2**31 - 1)
    return F.when(fits, d).try_cast("int")


def classify_body(body) -> Column:
    """route by content, as the replayer does.

    userId and quantity -> add-to-cart; userId only -> checkout; else restock.
    """
    b = _c(body)
    return (
        F.when(b.contains("userId") & b.contains("quantity"), F.lit("add-to-cart"))
        .when(b.contains("userId"), F.lit("checkout"))
        .otherwise(F.lit("restock"))
    )


def inject_poison(body) -> Column:
    """Replace the quantity number with ``-1`` (the whole number)."""
    return F.regexp_replace(_c(body), r'("quantity":)\s*"?-?[0-9]+"?', "$1-1")


def _nz_str(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def _nz_num(c: Column) -> Column:
    return F.when(c != F.lit(0), c)


def encode_add_to_cart(user, item, quantity, publish_ts) -> Column:
    """AddToCart as JSON; default values ("" and 0) are omitted."""
    return F.to_json(
        F.struct(
            _nz_str(_c(user).cast("string")).alias("userId"),
            _nz_str(_c(item).cast("string")).alias("itemId"),
            _nz_num(_c(quantity).cast("int")).alias("quantity"),
            _nz_str(_c(publish_ts).cast("string")).alias("publishTimestamp"),
        ),
        {"ignoreNullFields": "true"},
    )


def encode_receipt(user, receipt, publish_ts) -> Column:
    """Receipt as JSON."""
    return F.to_json(
        F.struct(
            _nz_str(_c(user).cast("string")).alias("userId"),
            _nz_str(_c(receipt)).alias("receipt"),
            _nz_str(_c(publish_ts).cast("string")).alias("publishTimestamp"),
        ),
        {"ignoreNullFields": "true"},
    )


def envelope(type_name: str, payload) -> Column:
    """Tagged envelope (type name + bytes) as a struct."""
    return F.struct(F.lit(type_name).alias("typename"), F.encode(_c(payload), "UTF-8").alias("value"))


def unpack_envelope(env) -> tuple[Column, Column]:
    e = _c(env)
    return e["typename"], F.decode(e["value"], "UTF-8")


def typed_envelope(type_name, message) -> Column:
    """A message (a struct) as (typename, payload): its type's name and its
    fields as VARIANT, so that messages of all types are one stream."""
    payload = F.parse_json(F.to_json(_c(message)))
    return F.struct((F.lit(type_name) if isinstance(type_name, str) else type_name).alias("typename"), payload.alias("payload"))


def open_envelope(payload, fields: dict[str, str]) -> list[Column]:
    """The declared fields of a VARIANT payload, by name and type; NULL
    where the message does not carry one."""
    return [F.try_variant_get(_c(payload), f"$.{name}", kind).alias(name) for name, kind in fields.items()]


def receipt_text(fmt: str, user, n) -> Column:
    """Receipt text from a format with {user} and {n}."""
    parts = []
    rest = fmt
    while rest:
        i_u, i_n = rest.find("{user}"), rest.find("{n}")
        cands = [(i, t) for i, t in ((i_u, "user"), (i_n, "n")) if i >= 0]
        if not cands:
            parts.append(F.lit(rest))
            break
        i, t = min(cands)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append((_c(user) if t == "user" else _c(n)).cast("string"))
        rest = rest[i + (6 if t == "user" else 3):]
    return F.concat(*parts)


def key_line(key, body) -> Column:
    """``key=json`` log line."""
    return F.concat(_c(key).cast("string"), F.lit("="), _c(body))
