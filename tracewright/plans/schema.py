"""The predicates of the pattern language and their attributes."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the language.
CALL_KINDS = ("External", "Internal", "Delegate", "StaticCall", "Create", "SelfDestruct")
DIRECTIONS = ("In", "Out")
TX_STATUSES = ("Success", "Reverted")
STORAGE_ROLES = ("PriceOracle", "Balance", "Accounting", "AccessControl")
SEVERITIES = ("Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Attribute:
    kind: str  # "bool", "int", "string" or "name"
    required: bool = False
    values: tuple[str, ...] = ()
    resolvable: bool = True  # False: no fact can confirm it; matches are flagged


PREDICATES: dict[str, dict[str, Attribute]] = {
    "call": {
        "kind": Attribute("name", True, CALL_KINDS),
        "reentrant": Attribute("bool"),
        "value_flow": Attribute("name", values=DIRECTIONS),
        "min_value": Attribute("int"),
        "selector": Attribute("string"),
        "succeeded": Attribute("bool"),
        "parent_kind": Attribute("name", values=CALL_KINDS),
        "ancestor_kind": Attribute("name", values=CALL_KINDS),
    },
    "storage": {
        "changed": Attribute("bool", True),
        "role": Attribute("name", values=STORAGE_ROLES, resolvable=False),
        "slot": Attribute("string"),
        "call_kind": Attribute("name", values=CALL_KINDS),
    },
    "value_flow": {
        "direction": Attribute("name", True, DIRECTIONS),
        "min": Attribute("int"),
        "max": Attribute("int"),
    },
    "token_transfer": {
        "direction": Attribute("name", True, DIRECTIONS),
        "unexpected": Attribute("bool", resolvable=False),
        "token": Attribute("string"),
    },
    "transaction": {
        "status": Attribute("name", True, TX_STATUSES),
        "gas_used_min": Attribute("int"),
    },
    "log": {
        "topic0": Attribute("string", True),
        "decoded": Attribute("bool"),
    },
}
