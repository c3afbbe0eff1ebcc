"""Rules that the relations of a trace must obey, checked in their order; the first broken one names the trace's error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, in the order in which they are checked.
RULES = (
    "empty-trace", "first-call-not-root", "multiple-roots", "forward-parent", "depth-mismatch",
    "dangling-storage-change", "dangling-log", "dangling-transfer", "static-call-with-value", "too-many-topics", "duplicate-log-index",
)


def first_error(check_depth: bool = True) -> Column:
    """The first rule that a trace row breaks; null if it breaks none."""
    n = F.size("calls")
    parent_of = lambda c: F.get(F.col("calls"), c["parent_id"])
    outside = lambda name: F.exists(name, lambda x: (x["call_id"] < 0) | (x["call_id"] >= n))
    depth = F.exists("calls", lambda c: c["parent_id"].isNotNull() & (c["depth"] != parent_of(c)["depth"] + 1)) if check_depth else F.lit(False)
    indexes = F.transform("logs", lambda x: x["log_index"])
    broken = [
        n == 0,
        F.get("calls", F.lit(0))["parent_id"].isNotNull(),
        F.size(F.filter("calls", lambda c: c["parent_id"].isNull())) > 1,
        F.exists("calls", lambda c: (c["parent_id"] >= c["call_id"]) | (c["parent_id"] < 0)),
        depth,
        outside("storage_changes"),
        outside("logs"),
        F.exists("token_transfers", lambda t: (t["log_id"] < 0) | (t["log_id"] >= F.size("logs"))),
        F.exists("calls", lambda c: (c["kind"] == "StaticCall") & (c["value_hex"] != "0" * 32)),
        F.exists("logs", lambda x: F.size(x["topics"]) > 4),
        F.size(F.array_distinct(indexes)) < F.size(indexes),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, test in zip(RULES, broken):
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out


def check(traces: DataFrame, check_depth: bool = True) -> DataFrame:
    """trace_id, error for each trace row."""
    return traces.select("trace_id", first_error(check_depth).alias("error"))


def dangling(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """The facts whose call is not there, as an anti-join of relations."""
    return facts.join(calls.select("trace_id", "call_id"), ["trace_id", "call_id"], "left_anti")
