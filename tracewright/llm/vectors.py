"""What the vector operators share: which vectors take part, and their Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(e: Column) -> Column:
    """False for null, empty and zero vectors and for null or non-finite components."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very small and large components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.Array):
    """Groups of rows whose vectors have one length: row numbers and their matrix."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, matrix(column.take(pa.array(rows)))
