"""Public weakness registries by pattern family: a small lookup table, joined by broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries of the public registries. family, code, title, address.
SCWE = [
    ("Reentrancy", "SCWE-046", "Reentrancy Attacks", "https://scs.owasp.org/SCWE/SCSVS-CODE/SCWE-046/"),
    ("OracleManipulation", "SCWE-028", "Price Oracle Manipulation", "https://scs.owasp.org/SCWE/SCSVS-ORACLE/SCWE-028/"),
    ("UnauthorizedUpgrade", "SCWE-005", "Insecure Upgradeable Proxy Design", "https://scs.owasp.org/SCWE/SCSVS-ARCH/SCWE-005/"),
    ("UncheckedExternalCall", "SCWE-048", "Unchecked Call Return Value", "https://scs.owasp.org/SCWE/SCSVS-CODE/SCWE-048/"),
    ("DelegatecallStorageCollision", "SCWE-150", "Storage Slot Collision When Upgrading Implementation", "https://scs.owasp.org/SCWE/SCSVS-ARCH/SCWE-150/"),
    ("UnsafeSelfdestruct", "SCWE-050", "Unprotected SELFDESTRUCT Instruction", "https://scs.owasp.org/SCWE/SCSVS-AUTH/SCWE-050/"),
    ("DelegatecallReachableSelfdestruct", "SCWE-038", "Insecure Use of Selfdestruct", "https://scs.owasp.org/SCWE/SCSVS-AUTH/SCWE-038/"),
    ("SpoofedTransferEvent", "SCWE-063", "Insecure Event Emission", "https://scs.owasp.org/SCWE/SCSVS-COMM/SCWE-063/"),
]
SWC = [
    ("Reentrancy", "SWC-107", "Reentrancy", "https://swcregistry.io/docs/SWC-107/"),
    ("UncheckedExternalCall", "SWC-104", "Unchecked Call Return Value", "https://swcregistry.io/docs/SWC-104/"),
    ("DelegatecallStorageCollision", "SWC-112", "Delegatecall to Untrusted Callee", "https://swcregistry.io/docs/SWC-112/"),
    ("UnsafeSelfdestruct", "SWC-106", "Unprotected SELFDESTRUCT Instruction", "https://swcregistry.io/docs/SWC-106/"),
    ("DelegatecallReachableSelfdestruct", "SWC-106", "Unprotected SELFDESTRUCT Instruction", "https://swcregistry.io/docs/SWC-106/"),
]

Mapper = Callable[[str], list[tuple[str, str, str | None]]]


def _table(rows) -> dict[str, list[tuple[str, str, str | None]]]:
    out: dict[str, list] = {}
    for family, *entry in rows:
        out.setdefault(family, []).append(tuple(entry))
    return out


class Registry:
    """Taxonomies by name, in alphabetical order; a name registered again is replaced."""

    def __init__(self):
        self._mappers: dict[str, Mapper] = {}
        for name, rows in (("SCWE", SCWE), ("SWC", SWC)):
            self.register(name, lambda family, t=_table(rows): t.get(family, []))

    def register(self, name: str, mapper: Mapper) -> None:
        self._mappers[name] = mapper

    @property
    def names(self) -> list[str]:
        return sorted(self._mappers)

    def map_family(self, family: str) -> list[dict]:
        """taxonomy, code, title, reference_url of each entry."""
        return [dict(zip(("taxonomy", "code", "title", "reference_url"), (name, *entry))) for name in self.names for entry in self._mappers[name](family)]

    def unmapped(self, family: str) -> list[str]:
        return [name for name in self.names if not self._mappers[name](family)]

    def frame(self, spark: SparkSession, families: list[str]) -> DataFrame:
        """One row for each family: its entries, and the taxonomies that have none."""
        rows = [(f, [tuple(e.values()) for e in self.map_family(f)], self.unmapped(f)) for f in dict.fromkeys(families)]
        kinds = "pattern_family string, taxonomy array<struct<taxonomy: string, code: string, title: string, reference_url: string>>, unmapped array<string>"
        return spark.createDataFrame(rows, kinds)

    def attach(self, findings: DataFrame, families: list[str]) -> DataFrame:
        """findings with `taxonomy` and `unmapped`, whatever their status. The table has one short row for each family."""
        return findings.join(F.broadcast(self.frame(findings.sparkSession, families)), "pattern_family", "left")


DEFAULT = Registry()
