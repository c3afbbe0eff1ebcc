"""How filters interact: every order of five filters, audited from counts of documents by what they fail.

The documents are read once: which conditions a text fails is one number (a mask), and all that any
order needs are counts by part and mask, 32 at most for each part. The orders are then visited by
exchanging two neighbours at a time; only the two steps at the exchange change, as each other step
still has the same filters before it. A filter's Shapley total is the sum over the walk of what it
removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORD_CLASS, Scratch, pieces, text_buffer, words

FILTERS = "ABCDE"
SHORT, VARIED, CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

# ---------------------------------------------------------------- conditions of single texts


def _of_class(*members: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CAPITAL, _MARK, _FOLLOWS = _of_class(*range(0x41, 0x5B)), _of_class(*MARKS), _of_class(*range(0x80, 0xC0))


def _sums(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the number of its bytes that are flagged."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in pieces(offsets):
        if j - i == 1:
            out[i] = sum(int(np.count_nonzero(flags[data[k : min(k + SLICE_BYTES, offsets[j])]])) for k in range(offsets[i], offsets[j], SLICE_BYTES))
            continue
        upto = np.concatenate([[0], np.cumsum(flags[data[offsets[i] : offsets[j]]])])
        out[i:j] = np.diff(upto[offsets[i : j + 1] - offsets[i]])
    return out


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits A to D of each text: what it fails by itself. Null is empty."""
    data, offsets = text_buffer(texts)
    hashes, first = words(data, offsets, WORD_CLASS, fold=False)
    n = np.diff(first)
    distinct = np.zeros(len(n), np.int64)
    for i, j in pieces(first):
        h, own = hashes[first[i] : first[j]], np.repeat(np.arange(j - i), n[i:j])
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        distinct[i:j] = np.bincount(own[new], minlength=j - i)
    letters = np.diff(offsets) - _sums(_FOLLOWS, data, offsets)
    fails = (n < SHORT, 100 * distinct < VARIED * n, 100 * _sums(_CAPITAL, data, offsets) > CAPITALS * letters, _sums(_MARK, data, offsets) > 0)
    return sum(x.astype(np.int32) << k for k, x in enumerate(fails))


# ---------------------------------------------------------------- counts


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text and mask (bits A to D) of each row; one pass over the texts."""

    def masks(batches):
        for b in batches:
            columns = [b.column("doc_id"), b.column("part"), b.column("digest"), pa.array(text_masks(b.column("text")), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "digest", "mask"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(masks, "doc_id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail.

    E fails where a smaller id has the same text. Rows of the smallest id all pass it, so the rows that pass
    are found by text and id together, and no group of copies of any size meets in one task.
    """
    rows = Scratch(docs.sparkSession).save(failures(docs, part), "failures")
    # rows that share id, text and part are one from here on
    each = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    named = each.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    weight = lambda c: F.when(F.col(c), F.col("n")).otherwise(0)
    named = named.select("part", (F.col("mask") + copy).alias("mask"), "n", weight("good").alias("good"), weight("toxic").alias("toxic"))
    nameless = each.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


# ---------------------------------------------------------------- orders


def exchanges(n: int) -> Iterator[int | None]:
    """The walk over all orders of n things: None, then for each next order the place i whose thing
    goes to i + 1 and back. The last thing sweeps through the others, which move once between sweeps."""
    yield None
    if n < 2:
        return
    inner, back = exchanges(n - 1), True
    next(inner)
    while True:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        moved = next(inner, None)
        if moved is None:
            return
        yield moved + 1 if back else moved  # the last thing stands in front, or at the end
        back = not back


def audit_part(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """filter_order, step and COUNTS for each order and step, from counts by mask."""
    size = len(filters)
    masks = np.arange(1 << size)

    def step(f: int, before: int) -> tuple[int, ...]:
        fails, passed = (masks >> f & 1).astype(bool), masks & before == 0
        out = fails & passed
        return tuple(int(x) for x in (n[passed & ~fails].sum(), n[out].sum(), n[fails & ~passed].sum(), n[1 << f], good[out].sum(), toxic[out].sum()))

    order, shapley, seen = list(range(size)), [0] * size, []
    steps = [step(f, (1 << f) - 1) for f in order]
    for i in exchanges(size):
        if i is not None:
            order[i], order[i + 1] = order[i + 1], order[i]
            before = sum(1 << f for f in order[:i])
            steps[i], steps[i + 1] = step(order[i], before), step(order[i + 1], before | 1 << order[i])
        for f, s in zip(order, steps):
            shapley[f] += s[1]
        seen.append((tuple(order), tuple(steps)))
    return [("".join(filters[f] for f in o), k + 1, *s, shapley[f]) for o, own in seen for k, (f, s) in enumerate(zip(o, own))]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS: all 120 orders of the five filters in each part.

    Null text is empty text, a null part the empty string. A row without an id is no copy of another
    and has no labels; rows of one id and text are all counted and are no copies of each other. Rows
    of `labels` that share an id count once, as good or toxic if one of them says so. Other columns
    are ignored. Long texts are taken whole. An empty table has no parts and gives no rows.
    """

    def walk(batches):
        for b in batches:
            out: list[tuple] = []
            for name, own in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in own:
                    counts[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                out += [(name, *row) for row in audit_part(*counts)]
            kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(COUNTS)
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "filter_order", "step", *COUNTS])

    own = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return own.mapInArrow(walk, _SCHEMA)
