"""Facts about a call that depend on the calls above it.

They are found by walking up, all calls of a batch of traces a step at a time, so the cost is
the sum of the calls' depths whatever the shape and size of a trace. One Arrow function gives
the numbers; texts are looked up from them in columns. Each trace keeps its row, so ids play no
part: they may be null or come twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.hexcodec import kind_bit
from ..model import CALL, columns_of, rows_of

BORROWED = ("DelegateCall", "CallCode")
ADDED = ("reentrant", "above", "parent_kind", "context", "level")
_WALKED = pa.struct([("reentrant", pa.bool_()), ("above", pa.int32()), ("context_of", pa.int32()), ("level", pa.int32())])


def walk_up(parent: np.ndarray, target: np.ndarray, bits: np.ndarray, borrowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each call: does a call above have its target (-1: none), the bits of all calls above,
    the call whose storage it works on, and how many calls are above. parent: -1 for a root."""
    n = len(parent)
    reentrant, above, level, at = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int32), parent.copy()
    left = np.flatnonzero(at >= 0)
    while len(left):
        up = at[left]
        reentrant[left] |= (target[up] == target[left]) & (target[left] >= 0)
        above[left] |= bits[up]
        level[left] += 1
        at[left] = parent[up]
        left = left[at[left] >= 0]
    context = np.where(borrowed & (parent >= 0), parent, np.arange(n))
    while ((further := context[context]) != context).any():
        context = further
    return reentrant, above, context, level


@F.arrow_udf(from_arrow_type(pa.list_(_WALKED)))
def _walked(calls: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(calls), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    flat, start = calls.flatten(), np.repeat(first[:-1], size)
    field = lambda k, empty: pc.fill_null(flat.field(k), empty).to_numpy(zero_copy_only=False)
    parent, own = field("parent_id", -1).astype(np.int64), np.arange(len(flat)) - start
    unsound = ((parent < 0) & pc.is_valid(flat.field("parent_id")).to_numpy(zero_copy_only=False)) | (parent >= own) & (parent >= 0)
    broken = np.zeros(len(size), bool)
    broken[np.repeat(np.arange(len(size)), size)[unsound]] = True
    parent = np.where((parent >= 0) & ~unsound, parent + start, -1)
    target = pc.fill_null(flat.field("to_addr").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    reentrant, above, context, level = walk_up(parent, target, field("bit", 0).astype(np.int32), field("borrowed", False).astype(bool))
    parts = [pa.array(reentrant), pa.array(above, pa.int32()), pa.array((context - start).astype(np.int32)), pa.array(level)]
    found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(_WALKED)))
    good = pc.and_(pc.is_valid(calls), pa.array(~broken))
    return found if broken.sum() + calls.null_count == 0 else pc.if_else(good, found, pa.scalar(None, pa.list_(_WALKED)))


def enrich_traces(traces: DataFrame) -> DataFrame:
    """Trace rows whose calls have, besides their own fields, reentrant, above (classes of the calls
    above, as bits), parent_kind, context and level (how many calls are above). Ids of calls are dense, from 0. A trace in which a
    parent does not come before its call (later, missing, or in a circle) has null calls, and with that
    no findings; integrity.first_error names what is wrong with it."""
    slim = F.transform(
        "calls",
        lambda c: F.struct(c["parent_id"].alias("parent_id"), c["to_addr"].alias("to_addr"), kind_bit(c["kind"]).alias("bit"), F.coalesce(c["kind"].isin(*BORROWED), F.lit(False)).alias("borrowed")),
    )

    def merged(c: Column, f: Column) -> Column:
        own = F.get("calls", f["context_of"])
        facts = f["reentrant"], f["above"], F.get("calls", c["parent_id"])["kind"], F.coalesce(own["to_addr"], own["from_addr"]), f["level"]
        return F.struct(*(c[x].alias(x) for x in columns_of(CALL)), *(x.alias(name) for x, name in zip(facts, ADDED)))

    names = traces.columns
    return traces.withColumn("_walked", _walked(slim)).withColumn("calls", F.zip_with("calls", "_walked", merged)).select(*names)


def enriched_calls(traces: DataFrame) -> DataFrame:
    """One row for each call of enriched trace rows."""
    return traces.select("trace_id", rows_of("calls"))
