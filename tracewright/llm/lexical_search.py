"""Ranked lexical search by max trees over ranges of documents.

Documents stand in ranges of LEAF. For each term a range has the largest part that the term may add to
the score of one of its documents; ranges of FAN ranges have the largest of those, and so on up to the
roots. The sum of a range's maxima over an item's terms is a bound on all its documents. A search opens
the range of the highest bound first, and ends where no bound is as high as the k-th best score found;
ranges whose bound equals it are opened too, as they may hold a smaller id of the same score.

Texts are read once, and the counts of the terms that are asked for are written, a row for each lowest
range. Whole-table counts come from those rows. A first search of few ranges in each task finds a floor
for each item (the k-th best score of some task), the second opens whatever may reach it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import Scratch, text_buffer, words

TOP = 20
LEAF, FAN = 16, 16  # documents in a lowest range, ranges in a range
BLOCK_TERMS = 1 << 17  # terms of the items that are searched in one pass
TREE_CELLS = 1 << 22  # terms times lowest ranges of one tree
FIRST_RANGES = 4  # lowest ranges that the first search opens for an item in each tree

TERM_CLASS = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    TERM_CLASS[_b] = 1

# ---------------------------------------------------------------- scores


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents by their numbers of terms; whole numbers of any size are divided exactly."""
    if not len(lengths):
        return lengths
    if 25 * int(lengths.max()) * n_docs < 1 << 62:
        return 75 + 25 * lengths * n_docs // n_terms
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


# ---------------------------------------------------------------- ranges


_RANGES = "doc_ids array<long>, lengths array<long>, entries array<int>, terms binary, counts binary, n_docs long, n_terms long"
_RANGE_KINDS = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64())


def ranges(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each LEAF documents: ids and numbers of terms of those that hold a term of the vocabulary (sorted
    hashes), the terms (places in the vocabulary) and how often they occur; how many documents and terms there are."""

    def rows(batches):
        for b in batches:
            hashes, first = words(*text_buffer(b.column("text")), TERM_CLASS)
            place = np.searchsorted(vocabulary, hashes)
            known = place < len(vocabulary)
            known[known] = vocabulary[place[known]] == hashes[known]
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))[known]
            pair, counts = np.unique(doc * len(vocabulary) + place[known], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(vocabulary)))
            lengths, held = np.diff(first), np.bincount(doc, minlength=b.num_rows)
            start, ids = np.concatenate([[0], np.cumsum(held)]), b.column("doc_id").to_pylist()
            out = []
            for i in range(0, b.num_rows, LEAF):
                j = min(i + LEAF, b.num_rows)
                own = [k for k in range(i, j) if held[k]]
                at = slice(start[i], start[j])
                out.append(([ids[k] for k in own], lengths[own].tolist(), held[own].tolist(), term[at].astype("<i4").tobytes(), counts[at].astype("<i4").tobytes(), int(np.count_nonzero(lengths[i:j])), int(lengths[i:j].sum())))
            columns = zip(*out) if out else [()] * len(_RANGE_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RANGE_KINDS)], [c.split()[0] for c in _RANGES.split(", ")])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, _RANGES)


def totals(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary."""

    def count(batches):
        df, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(_joined(b.column("terms")), minlength=n_terms)
            docs, terms = docs + sum(b.column("n_docs").to_pylist()), terms + sum(b.column("n_terms").to_pylist())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([docs, terms, *df[some].tolist()], pa.int64())], ["term", "n"])

    counted = index.select("terms", "n_docs", "n_terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # as many rows as the items have terms, at most BLOCK_TERMS
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4")


# ---------------------------------------------------------------- the tree


class MaxTree:
    """Maxima by range and term, from the lowest ranges up; rows are ranges, columns terms."""

    def __init__(self, batch: pa.RecordBatch, n_vocabulary: int, n_docs: int, n_terms: int):
        held = np.array([x for own in batch.column("entries").to_pylist() for x in own], np.int64)
        lengths = np.array([x for own in batch.column("lengths").to_pylist() for x in own], np.int64)
        self.ids = [x for own in batch.column("doc_ids").to_pylist() for x in own]
        self.leaf = np.concatenate([[0], np.cumsum([len(x) for x in batch.column("doc_ids").to_pylist()])]).astype(np.int64)  # documents by range
        self.first = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)  # entries by document
        self.terms = _joined(batch.column("terms"))
        tf = _joined(batch.column("counts")).astype(np.int64)
        self.parts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(norms(lengths, n_docs, n_terms), held))  # below 10^6
        n = len(self.leaf) - 1
        lowest = np.zeros((n, n_vocabulary), np.int32)
        owner = np.repeat(np.repeat(np.arange(n), np.diff(self.leaf)), held)
        np.maximum.at(lowest.reshape(-1), owner * n_vocabulary + self.terms, self.parts.astype(np.int32))
        self.levels = [lowest]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))

    def bounds(self, level: int, i: int, j: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.levels[level][i:j, terms] @ weights

    def scores(self, leaf: int, by_term: np.ndarray) -> tuple[range, np.ndarray]:
        """The documents of a lowest range and their exact scores."""
        own = range(self.leaf[leaf], self.leaf[leaf + 1])
        start = self.first[own.start : own.stop]
        at = slice(self.first[own.start], self.first[own.stop])
        return own, np.add.reduceat(by_term[self.terms[at]] * self.parts[at], start - at.start) if len(own) else start

    def search(self, best: Best, terms: np.ndarray, weights: np.ndarray, by_term: np.ndarray, most: float = math.inf) -> None:
        """Open ranges, the highest bound first, while a bound is as high as the score that is asked for."""
        top = len(self.levels) - 1
        opened = 0
        heap = [(-int(self.bounds(top, 0, 1, terms, weights)[0]), top, 0)]
        while heap and -heap[0][0] >= best.least and opened < most:
            _, level, node = heapq.heappop(heap)
            if level == 0:
                own, scores = self.scores(node, by_term)
                for k in np.flatnonzero(scores >= best.least).tolist():
                    best.add(int(scores[k]), self.ids[own[k]])
                opened += 1
                continue
            i = node * FAN
            found = self.bounds(level - 1, i, i + FAN, terms, weights)
            for k in np.flatnonzero(found >= best.least).tolist():
                heapq.heappush(heap, (-int(found[k]), level - 1, i + k))


class Best:
    """The k best of what is added: by score, then by id (none comes last). `least` is the score to reach."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.least, self._heap, self._n = k, floor, [], 0

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, (0, 0) if doc_id is None else (1, -doc_id))
        if len(self._heap) < self.k:
            heapq.heappush(self._heap, entry)
        elif entry > self._heap[0]:
            heapq.heapreplace(self._heap, entry)
        if len(self._heap) == self.k:
            self.least = max(self.least, self._heap[0][0])

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, -i if known else None) for s, (known, i) in sorted(self._heap, reverse=True)]


# ---------------------------------------------------------------- items


class Items:
    """Some items: their ids, and the terms (places in the vocabulary) and repeats of each."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        hashes = [np.frombuffer(r["terms"], "<u8") for r in rows]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.terms = [np.searchsorted(self.vocabulary, h) for h in hashes]
        self.repeats = [np.frombuffer(r["repeats"], "<i8") for r in rows]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, the hashes of its distinct terms, how often each occurs. Rows of one id are one item."""

    def cut(batches):
        for b in batches:
            hashes, first = words(*text_buffer(b.column("text")), TERM_CLASS)
            own = pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(own), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    def pack(batches):
        for b in batches:
            both = [(np.array([x["term"] for x in own], "<i8").tobytes(), np.array([x["n"] for x in own], "<i8").tobytes()) for own in b.column("own").to_pylist()]
            terms, repeats = zip(*both) if both else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(terms, pa.binary()), pa.array(repeats, pa.binary())], ["item_id", "terms", "repeats"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, f"item_id {kind}, term long")
    counted = each.groupBy("item_id", "term").agg(F.count("*").alias("n"))
    return counted.groupBy("item_id").agg(F.collect_list(F.struct("term", "n")).alias("own")).mapInArrow(pack, f"item_id {kind}, terms binary, repeats binary")


def _trees(batches: Iterator[pa.RecordBatch], n_vocabulary: int, n_docs: int, n_terms: int) -> Iterator[MaxTree]:
    size = max(FAN, TREE_CELLS // max(1, n_vocabulary))
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield MaxTree(b.slice(i, size), n_vocabulary, n_docs, n_terms)


def _search_block(scratch: Scratch, docs: DataFrame, items: Items, kind: DataType, top: int) -> DataFrame:
    index = scratch.save(ranges(docs, items.vocabulary), "ranges")
    size = len(items.vocabulary)
    n_docs, n_terms, df = totals(index, size)
    by_df = {int(d): weight(n_docs, int(d)) for d in np.unique(df)}
    weights = np.array([by_df[d] for d in df.tolist()], np.int64)
    own = [(t, weights[t] * r) for t, r in zip(items.terms, items.repeats)]

    def best_of(batches, floors: list[int], most: float) -> list[Best]:
        best = [Best(top, f) for f in floors]
        by_term = np.zeros(size, np.int64)
        for tree in _trees(batches, size, n_docs, n_terms):
            for found, (terms, w) in zip(best, own):
                by_term[terms] = w
                tree.search(found, terms, w, by_term, most)
                by_term[terms] = 0
        return best

    def floors(batches):
        best = best_of(batches, [1] * len(own), FIRST_RANGES)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array([b.least for b in best], pa.int64())], ["item", "least"])

    lowest = dict(index.mapInArrow(floors, "item long, least long").groupBy("item").agg(F.max("least")).collect()) if n_docs else {}
    least = [lowest.get(i, 1) for i in range(len(own))]

    def search(batches):
        rows = [(i, *r) for i, b in zip(items.ids, best_of(batches, least, math.inf)) for r in b.rows()]
        ids, scores, found = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return index.mapInArrow(search, f"item_id {kind.simpleString()}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the documents of the highest scores above 0 for each item.

    All documents are ranked, whole texts of any length; null text has no terms. Each row of `docs` is a
    document: rows that share an id stand one by one. Among equal scores the smaller id comes first,
    rows without an id last. Rows of `items` that share an id (none is an id, too) are one item with
    the terms of all; items without terms, or whose terms no document holds, give no rows. Extra
    columns are ignored; an empty table on either side gives no rows. Items are taken in blocks of
    about BLOCK_TERMS terms, each a pass over the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = items.schema["item_id"].dataType
    asked = scratch.save(item_terms(items), "items")
    n = asked.agg(F.sum(F.octet_length("terms") / 8)).first()[0] or 0
    blocks = max(1, -(-int(n) // BLOCK_TERMS))
    found = None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        part = _search_block(scratch, docs, Items(own), kind, top)
        found = part if found is None else found.unionByName(part)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
