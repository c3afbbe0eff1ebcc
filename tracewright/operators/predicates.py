"""The six evidence predicates, as conditions on facts.

A condition is written over `get`, which gives a fact's field as a column, and the
transaction's fields; so the same code filters a relation's rows and an array's elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexcodec import MAX_U128_HEX, class_bit, kind_class
from ..plans.compiler import Clause

Get = Callable[[str], Column]
BINDING = "struct<fact_kind: string, fact_id: int, ord: int, call_id: int>"


@dataclass(frozen=True)
class Source:
    """Where a predicate's facts are: the array, the fact's kind, its id and its producing call."""

    array: str
    fact_kind: str
    id: str
    call: str = "call_id"


SOURCES = {
    "call": Source("calls", "Call", "call_id"),
    "storage": Source("storage_changes", "StorageChange", "id"),
    "value_flow": Source("calls", "Call", "call_id"),
    "token_transfer": Source("token_transfers", "TokenTransfer", "id"),
    "log": Source("logs", "Log", "id"),
}


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def _hex(value: object, digits: int) -> str | None:
    """A pattern's hex literal in canonical form; None if it has another number of digits."""
    m = re.fullmatch(r"(?:0x)?([0-9a-fA-F]+)", str(value))
    return "0x" + m[1].lower() if m and len(m[1]) == digits else None


def _equals(field: Column, literal: str | None) -> Column:
    return F.lit(False) if literal is None else field == literal


def _at_least(amount: Column, least: int) -> Column:
    return F.lit(True) if least <= 0 else amount >= f"{least:032x}"


def _at_most(amount: Column, most: int) -> Column:
    return F.lit(False) if most < 0 else amount <= f"{most:032x}"


def _direction(get: Get, direction: object, sender: Column) -> Column:
    return get("to_addr" if direction == "In" else "from_addr") == sender


def _call(a: dict, get: Get, tx: Get, calls: Column | None) -> list[Column]:
    rules = {
        "kind": lambda v: kind_class(get("kind")) == v,
        "reentrant": lambda v: get("reentrant") == v,
        "value_flow": lambda v: _direction(get, v, tx("from_addr")),
        "min_value": lambda v: _at_least(get("value_hex"), v),
        "selector": lambda v: _equals(get("selector"), _hex(v, 8)),
        "succeeded": lambda v: get("succeeded") == v,
        "parent_kind": lambda v: kind_class(get("parent_kind")) == v,
        "ancestor_kind": lambda v: get("above").bitwiseAND(class_bit(v)) != 0,
    }
    return [rules[k](v) for k, v in a.items()]


def _storage(a: dict, get: Get, tx: Get, calls: Column | None) -> list[Column]:
    out = [(get("before") != get("after")) == a["changed"]]
    if "slot" in a:
        out.append(_equals(get("slot"), _hex(a["slot"], 64)))
    if "call_kind" in a:
        kind = get("call_kind") if calls is None else F.get(calls, get("call_id"))["kind"]
        out.append(kind_class(kind) == a["call_kind"])
    return out


def _value_flow(a: dict, get: Get, tx: Get, calls: Column | None) -> list[Column]:
    out = [get("value_hex") != "0" * 32, _direction(get, a["direction"], tx("from_addr"))]
    if "min" in a:
        out.append(_at_least(get("value_hex"), a["min"]))
    if "max" in a:
        out.append(_at_most(get("value_hex"), a["max"]))
    return out


def _token_transfer(a: dict, get: Get, tx: Get, calls: Column | None) -> list[Column]:
    out = [_direction(get, a["direction"], tx("from_addr"))]
    if "token" in a:
        out.append(_equals(get("token"), _hex(a["token"], 40)))
    return out


def _log(a: dict, get: Get, tx: Get, transfers: Column | None) -> list[Column]:
    out = [_equals(F.get(get("topics"), F.lit(0)), _hex(a["topic0"], 64))]
    if "decoded" in a:
        decoded = get("decoded") if transfers is None else F.exists(transfers, lambda t: t["log_id"] == get("id"))
        out.append(decoded == a["decoded"])
    return out


RULES = {"call": _call, "storage": _storage, "value_flow": _value_flow, "token_transfer": _token_transfer, "log": _log}


def transaction_holds(clause: Clause, tx: Get) -> Column:
    out = [tx("status") == clause.attributes["status"]]
    if "gas_used_min" in clause.attributes:
        out.append(tx("gas_used") >= F.lit(clause.attributes["gas_used_min"]))
    return _all(out)


def bindings(clause: Clause) -> Column:
    """The facts of a trace row that satisfy a clause, by order, then id. Facts of the transaction have no order.

    Facts are in id order, and a fact's producing call never comes after a later fact's, but
    for token transfers and logs the order key may differ from the id, so they are sorted.
    """
    tx = lambda name: F.col(f"tx.{name}")
    none = F.array().cast(f"array<{BINDING}>")
    if clause.kind == "transaction":
        root = F.struct(F.lit("Call").alias("fact_kind"), F.lit(0).alias("fact_id"), F.lit(None).cast("int").alias("ord"), F.lit(0).alias("call_id"))
        return F.when(transaction_holds(clause, tx), F.array(root)).otherwise(none)
    if clause.kind not in RULES:
        return none
    at = SOURCES[clause.kind]
    attributes = {k: v for k, v in clause.attributes.items() if k not in clause.unresolved}
    other = {"storage": F.col("calls"), "log": F.col("token_transfers")}.get(clause.kind)
    found = F.filter(at.array, lambda x: _all(RULES[clause.kind](attributes, lambda name: x[name], tx, other)))
    made = F.transform(
        found,
        lambda x: F.struct(F.lit(at.fact_kind).alias("fact_kind"), x[at.id].alias("fact_id"), x[at.call].alias("ord"), x[at.call].alias("call_id")),
    )
    if at.array == "calls":
        return made
    return F.array_sort(made, lambda a, b: F.when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(a["fact_id"] - b["fact_id"]))


def select_facts(clause: Clause, facts: DataFrame, tx: DataFrame, calls: DataFrame | None = None, transfers: DataFrame | None = None) -> DataFrame:
    """The rows of one relation that satisfy a clause, as joins: trace_id, fact_kind, fact_id, ord, call_id.

    `facts` is the clause's relation (calls enriched; for a transaction clause, tx itself).
    """
    if clause.kind == "transaction":
        held = facts.where(transaction_holds(clause, F.col))
        return held.select("trace_id", F.lit("Call").alias("fact_kind"), F.lit(0).alias("fact_id"), F.lit(None).cast("int").alias("ord"), F.lit(0).alias("call_id"))
    at = SOURCES[clause.kind]
    attributes = {k: v for k, v in clause.attributes.items() if k not in clause.unresolved}
    rows = facts
    if "call_kind" in attributes:
        rows = rows.join(calls.select("trace_id", "call_id", F.col("kind").alias("call_kind")), ["trace_id", "call_id"])
    if "decoded" in attributes:
        how = "left_semi" if attributes.pop("decoded") else "left_anti"
        rows = rows.join(transfers.select("trace_id", F.col("log_id").alias("id")), ["trace_id", "id"], how)
    if "value_flow" in attributes or "direction" in attributes:
        rows = rows.join(tx.select("trace_id", F.col("from_addr").alias("_sender")), "trace_id")
    held = rows.where(_all(RULES[clause.kind](attributes, F.col, lambda _: F.col("_sender"), None)))
    return held.select(
        "trace_id", F.lit(at.fact_kind).alias("fact_kind"), F.col(at.id).alias("fact_id"), F.col(at.call).alias("ord"), F.col(at.call).alias("call_id")
    )
