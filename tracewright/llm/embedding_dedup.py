"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors are compared when their labels (and lengths) are equal. Equal vectors are one class
with a multiplicity. Each table hashes a class to the signs of its products with random
hyperplanes; the number of tables follows from the bits, so that a pair at the threshold
meets in some table with probability `recall`. A bucket is taken in cells of at most two blocks
of BLOCK vectors, so a bucket of any size is spread over tasks and no cell grows. Cells first
get sign bits only, and tell which vectors have a partner there that may be near enough; those
alone are sent to their cells whole, and compared exactly. A pair that meets in several tables
counts in the first only. A cell returns, for each vector, the number of its links and one edge
to its local group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism
from .components import components
from .vectors import by_length, units, usable

THRESHOLD, RECALL, BUCKET, BLOCK, SEED = 0.98, 0.999, 64, 1024, 7


def plan(n: int, threshold: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits and tables: buckets of about `bucket` of n evenly spread vectors, and the recall at the threshold."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, n) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng([SEED, x.shape[1], bits, tables]).standard_normal((x.shape[1], bits * tables))
    signs = (units(x) @ planes >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits))


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """rep and its code in each table."""

    def run(batches):
        for b in batches:
            codes = np.zeros((b.num_rows, tables), np.int64)
            for _, rows, x in by_length(b.column("e")):
                codes[rows] = _codes(x, bits, tables)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), flat], ["rep", "codes"])

    return classes.select("rep", "e").mapInArrow(run, "rep long, codes array<int>")


def _cells(batches, lists: dict[str, int]):
    """Columns of one cell after the other, as arrays, from rows sorted by d, t and cell. lists: the list columns, and how many values a row has (0: d of them)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        flat = {c: t[c].chunk(0) for c in t.column_names}
        columns = {c: x.to_numpy(zero_copy_only=False) for c, x in flat.items() if c not in lists and c != "label"}
        label = flat["label"].dictionary_encode().indices.to_numpy()
        values = {c: flat[c].flatten().to_numpy(zero_copy_only=False) for c in lists}
        offsets = {c: np.concatenate([[0], np.cumsum(pa.compute.list_value_length(flat[c]).to_numpy())]) for c in lists}
        edges = np.flatnonzero((np.diff(columns["d"]) != 0) | (np.diff(columns["t"]) != 0) | (np.diff(columns["cell"]) != 0)) + 1
        bounds = [0, *edges.tolist(), t.num_rows]
        for i, j in zip(bounds[:-2], bounds[1:-1]):
            yield _cell(columns, label, values, offsets, i, j)
        held = t.slice(bounds[-2])
        last = lambda i=bounds[-2], j=bounds[-1], x=(columns, label, values, offsets): _cell(*x, i, j)
    if held is not None:
        yield last()


def _cell(columns: dict, label: np.ndarray, values: dict, offsets: dict, i: int, j: int) -> dict[str, np.ndarray]:
    out = {c: x[i:j] for c, x in columns.items()} | {"label": label[i:j]}
    return out | {c: x[offsets[c][i] : offsets[c][j]].reshape(j - i, -1) for c, x in values.items()}


def _pairs(c: dict[str, np.ndarray], near):
    """Pairs (i, j) of a cell's rows, of its two blocks, for which near(rows, columns) holds and which no earlier table has in one bucket."""
    lo, hi, table, codes = int(c["lo"][0]), int(c["hi"][0]), int(c["t"][0]), c["codes"]
    rows, cols = np.flatnonzero(c["block"] == lo), np.flatnonzero(c["block"] == hi)
    for at in range(0, len(rows), 256):
        r = rows[at : at + 256]
        i, j = np.nonzero(near(r, cols))
        i, j = r[i], cols[j]
        keep = (i < j if lo == hi else i != j) & (c["label"][i] == c["label"][j])
        i, j = i[keep], j[keep]
        first = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
        yield i[first], j[first]


def most_bits(bits: int, tables: int, threshold: float) -> int:
    """Sign bits in which a pair at the threshold hardly ever differs: the mean number and five standard deviations."""
    n, p = bits * tables, math.acos(threshold) / math.pi
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


SPOTS = "rep long, d int, t int, cell long, block int, lo int, hi int, codes array<int>"


def _plausible(bits: int, threshold: float):
    """The rows of each cell that have a partner there by their sign bits. Only their vectors are worth sending."""

    def run(batches):
        for c in _cells(batches, {"codes": 0}):
            codes, per = c["codes"].astype(np.uint64), 64 // bits
            words = np.stack([np.bitwise_or.reduce(codes[:, k : k + per] << (np.arange(min(per, codes.shape[1] - k), dtype=np.uint64) * np.uint64(bits)), axis=1) for k in range(0, codes.shape[1], per)], axis=1)
            most = most_bits(bits, codes.shape[1], threshold)

            def near(rows, cols, words=words, most=most):
                return sum(np.bitwise_count(words[rows, None, k] ^ words[None, cols, k]).astype(np.int32) for k in range(words.shape[1])) <= most

            used = np.zeros(len(codes), bool)
            for i, j in _pairs(c, near):
                used[i] = used[j] = True
            if used.any():
                flat = pa.array(c["codes"][used].ravel(), pa.int32())
                own = pa.ListArray.from_arrays(pa.array(np.arange(used.sum() + 1, dtype=np.int32) * codes.shape[1]), flat)
                names = ("rep", "d", "t", "cell", "block", "lo", "hi")
                yield pa.RecordBatch.from_arrays([*(pa.array(c[x][used]) for x in names), own], [*names, "codes"])

    return run


def _exact(threshold: float):
    """For each vector of a cell with links there: their number, and the smallest id that the cell's links reach."""

    def run(batches):
        for c in _cells(batches, {"codes": 0, "e": 0}):
            rep, many, u = c["rep"], c["many"], units(c["e"].astype(np.float64))
            links, group = np.zeros(len(rep), np.int64), rep.copy()
            a, b = [np.zeros(0, int)], [np.zeros(0, int)]
            for i, j in _pairs(c, lambda rows, cols, u=u: u[rows] @ u[cols].T >= threshold):
                np.add.at(links, i, many[j])
                np.add.at(links, j, many[i])
                a.append(i), b.append(j)
            a, b = np.concatenate(a), np.concatenate(b)
            while len(a):
                least, old = np.minimum(group[a], group[b]), group.copy()
                np.minimum.at(group, a, least)
                np.minimum.at(group, b, least)
                if (old == group).all():
                    break
            keep = links > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rep, links, group)], ["rep", "links", "to"])

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without label or id, link with nothing: n_links 0, their own component, kept. Rows that
    share an id are vectors each. Ties don't matter. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("e")).withColumn(
        "live", usable(F.col("e")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    )
    live = rows.where("live")
    key = ["label", "e"]
    classes = scratch.save(live.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    bits, tables = plan(classes.count(), threshold, recall, bucket)
    codes = scratch.save(hashed(classes, bits, tables), "codes")
    kind = classes.select("rep", "label", F.size("e").alias("d"))
    place = ["label", "d", "t", "code"]
    spots = codes.join(kind, "rep").select("rep", "label", "d", "codes", F.posexplode("codes").alias("t", "code"))
    crowded = spots.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    spots = spots.join(crowded, place).select("rep", *place, "codes", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    cells = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", *place, "codes", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    cells = cells.withColumn("cell", F.xxhash64(*place, "lo", "hi"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parallelism(spark), "cell").sortWithinPartitions("d", "t", "cell", "rep")

    names = ["rep", "label", "d", "t", "cell", "block", "lo", "hi", "codes"]
    wanted = scratch.save(dealt(cells.select(*names)).mapInArrow(_plausible(bits, threshold), SPOTS), "spots")
    full = wanted.join(classes.select("rep", "label", "many", "e"), "rep")
    found = scratch.save(dealt(full.select(*names, "many", "e")).mapInArrow(_exact(threshold), "rep long, links long, to long"), "found")
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = scratch.save(
        classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
            *key, (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
        ),
        "classes",
    )
    placed = live.select("vec_id", *key).join(per_class, key).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.col("live")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
