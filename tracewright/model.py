"""The trace model.

A trace is one row: its transaction, and arrays of calls, storage changes, logs and token
transfers, each in id order. All that a pattern can say is said about one trace, so with
everything of a trace in one row, matching and grounding are projections: any number of
patterns costs no shuffle. The relations, one row for each fact, are the other form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TX = (
    "tx_hash string, from_addr string, to_addr string, value_hex string, nonce decimal(20,0), gas_used decimal(20,0), "
    "status string, block_number decimal(20,0), block_ts decimal(20,0), chain_id decimal(20,0), base_fee_hex string, source string"
)
CALL = (
    "call_id int, parent_id int, kind string, depth int, from_addr string, to_addr string, value_hex string, "
    "gas_limit decimal(20,0), gas_used decimal(20,0), succeeded boolean, selector string"
)
STORAGE = "id int, call_id int, contract string, slot string, before string, after string"
LOG = "id int, call_id int, address string, topics array<string>, data string, log_index bigint"
TRANSFER = "id int, log_id int, call_id int, token string, from_addr string, to_addr string, amount_hex string"

FACTS = ("calls", "storage_changes", "logs", "token_transfers")
_TYPES = {"calls": CALL, "storage_changes": STORAGE, "logs": LOG, "token_transfers": TRANSFER}
_KEY = {"calls": "call_id"}


def fields_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) of each column of a schema; commas inside brackets don't divide."""
    return [tuple(part.split(None, 1)) for part in re.split(r", (?![^(<]*[)>])", schema)]


def columns_of(schema: str) -> list[str]:
    return [name for name, _ in fields_of(schema)]


def struct_type(schema: str) -> str:
    return f"struct<{', '.join(f'{name}: {kind}' for name, kind in fields_of(schema))}>"


def array_type(name: str) -> str:
    return f"array<{struct_type(_TYPES[name])}>"


def rows_of(array: str) -> Column:
    """An array of facts as rows, for a select. The slice is the whole array: to a plain column the
    optimizer would add a filter on its size, and have everything below computed twice for it."""
    return F.inline(F.slice(array, 1, (1 << 31) - 1))


@dataclass
class Relations:
    """One row for each fact, keyed by trace_id. value_flows() is a view of calls."""

    tx: DataFrame
    calls: DataFrame
    storage_changes: DataFrame
    logs: DataFrame
    token_transfers: DataFrame

    def register(self, prefix: str = "") -> None:
        """Make the relations known to SQL."""
        for name in ("tx", *FACTS):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        self.value_flows().createOrReplaceTempView(prefix + "value_flows")

    def value_flows(self) -> DataFrame:
        """Calls that carry value."""
        return self.calls.where(F.col("value_hex") != "0" * 32).select(
            "trace_id", "call_id", "from_addr", "to_addr", F.col("value_hex").alias("amount_hex")
        )

    def lookup(self, relation: str, keys: DataFrame) -> DataFrame:
        """The facts of a relation that (trace_id, id) keys name; keys that name nothing give nothing, a key that comes twice one row."""
        own = keys.select("trace_id", F.col("id").alias(_KEY.get(relation, "id")))
        return getattr(self, relation).join(own, own.columns, "left_semi")

    def fact(self, relation: str, trace_id, id_: int) -> DataFrame:
        """One fact by its key, or no row. The key is a filter, which reaches the scan of a written relation."""
        return getattr(self, relation).where((F.col("trace_id") == trace_id) & (F.col(_KEY.get(relation, "id")) == id_))

    def children_of(self, parent: int) -> DataFrame:
        return self.calls.where(F.col("parent_id") == parent)

    def root_calls(self) -> DataFrame:
        return self.calls.where(F.col("call_id") == 0)

    def storage_changes_for_call(self, call: int) -> DataFrame:
        return self.storage_changes.where(F.col("call_id") == call)


def to_traces(r: Relations) -> DataFrame:
    """Relations to trace rows. Each relation is shuffled once, by trace; traces without calls have no row."""

    def gathered(name: str) -> DataFrame:
        cols, key = columns_of(_TYPES[name]), _KEY.get(name, "id")
        first = F.struct(F.col(key).alias("_k"), F.struct(*cols).alias("v"))
        rows = getattr(r, name).groupBy("trace_id").agg(F.array_sort(F.collect_list(first)).alias("s"))
        return rows.select("trace_id", F.transform("s", lambda x: x["v"]).cast(array_type(name)).alias(name))

    out = r.tx.select("trace_id", F.struct(*columns_of(TX)).cast(struct_type(TX)).alias("tx")).join(gathered("calls"), "trace_id")
    for name in FACTS[1:]:
        out = out.join(gathered(name), "trace_id", "left").withColumn(name, F.coalesce(name, F.array().cast(array_type(name))))
    return out


def to_relations(traces: DataFrame) -> Relations:
    """Trace rows to relations, without a shuffle."""

    def of(name: str) -> DataFrame:
        return traces.select("trace_id", rows_of(name))

    return Relations(traces.select("trace_id", "tx.*"), *map(of, FACTS))
