"""

The four variants differ in what a request asks for, whether restocks count,
and how checkout answers.  A query names its profile; profiles are never
merged silently.  ``replace`` makes a test variant (e.g. a small initial
stock) without touching the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    # Stock of an item never seen before
    initial_stock: int = 100_000
    # R3: "unit" asks for 1 (a negative raw quantity passes through),
    # "quantity" asks for the real quantity, "echo" reserves nothing
    demand: str = "unit"
    # Whether a restock adds to the stock
    restock_applies: bool = False
    # quantity a restock event carries (reference sends 300)
    restock_qty: int = 300
    # R7 / R8: "clear" = receipt only with a basket, then clear;
    # "running" = always a receipt, never cleared; "none" = no receipts
    checkout: str = "clear"
    # Receipt text; {user} and {n} are filled in
    receipt_format: str = "User {user} receipt: {n} items"
    # topic names (S4, S5); the receipt topic differs per variant
    confirm_topic: str = "add-confirm"
    receipt_topic: str = "receipt"

    def with_(self, **kw) -> "Profile":
        return replace(self, **kw)


# Fixed values that must equal the reference's (topics, texts, stock).
PROFILES: dict[str, Profile] = {
    "embedded": Profile(
        name="embedded",
        initial_stock=100_000,
        demand="unit",
        restock_applies=False,
        checkout="clear",
        receipt_format="User {user} receipt: {n} items",
        receipt_topic="receipt",
    ),
    "remote": Profile(
        name="remote",
        initial_stock=100_000,
        demand="quantity",
        restock_applies=True,
        checkout="running",
        receipt_format="Total items: {n}",
        receipt_topic="receipts",
    ),
    "simple": Profile(
        name="simple",
        demand="echo",
        restock_applies=False,
        checkout="none",
    ),
    "harness": Profile(name="harness", demand="echo", checkout="none"),
}


def get_profile(name: str, **overrides) -> Profile:
    p = PROFILES[name]
    return p.with_(**overrides) if overrides else p
