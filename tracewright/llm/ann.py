"""Nearest neighbours by randomly rotated one-bit codes.

A vector, at length 1 and less a centre, is rotated into CODE_BITS dimensions and kept as the
signs, with two scalars: its length, and its product with its own code. A query, rotated
alike and rounded to four bit planes, estimates an inner product from the population counts
of the planes against the packed signs. The estimate has an error bound; only vectors whose
upper bound reaches the k-th best lower bound are compared exactly.

Each vector goes to one block of bounded size, is coded there once, and all queries pass by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism
from .vectors import by_length, matrix, units, usable

CODE_BITS, PLANES, EPSILON, SEED = 256, 4, 3.0, 11
ROWS, LEAST_ROWS, CENTRE_ROWS = 65_536, 1_024, 4_096  # vectors of a block at most; fewer while there are cores to spare


def rotation(d: int) -> np.ndarray:
    """d orthonormal columns in max(CODE_BITS, 64-fold of d) dimensions."""
    n = max(CODE_BITS, -(-d // 64) * 64)
    q, _ = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((n, d)))
    return q


class Codes:
    """The codes of a block of vectors."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        self.u = units(x)
        self.centre, self.turn = centre, rotation(x.shape[1])
        rest = self.u - centre
        self.length = np.sqrt((rest * rest).sum(axis=1))
        turned = rest @ self.turn.T
        n = turned.shape[1]
        signs = turned > 0
        self.packed = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        self.own = np.abs(turned).sum(axis=1) / np.sqrt(n) / np.maximum(self.length, 1e-300)
        self.ones = signs.sum(axis=1)
        self.with_centre = self.u @ centre
        spread = np.sqrt(np.maximum(0, 1 - self.own**2)) / np.maximum(self.own, 1e-9) / np.sqrt(n - 1)
        self.bound = EPSILON * spread * self.length

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the inner products with the unit vector q, and how far off they can be."""
        rest = q - self.centre
        turned = self.turn @ rest
        n, low = len(turned), turned.min()
        step = max((turned.max() - low) / ((1 << PLANES) - 1), 1e-12)
        rounded = np.rint((turned - low) / step).astype(np.uint8)
        count = np.zeros(len(self.u), np.int64)
        for k in range(PLANES):
            plane = np.packbits((rounded >> k) & 1, bitorder="little").view(np.uint64)
            count += np.bitwise_count(self.packed & plane).sum(axis=1, dtype=np.int64) << k
        dot = 2 * (low * self.ones + step * count) - (low * n + step * rounded.sum())  # with the code's signs
        inner = dot / np.sqrt(n) / np.maximum(self.own, 1e-9)  # with the direction of the vector's rest
        size = np.sqrt(rest @ rest)
        rounding = step * self.length / np.maximum(self.own, 1e-9)
        return inner * self.length + self.with_centre, self.bound * size + rounding + 1e-9


def _search(k: int, centre: dict[int, np.ndarray]):
    """Rows come by place: first a block of vectors (kind 0), which is coded once, then all queries (kind 1), a batch at a time."""

    def top(codes: Codes, ids: np.ndarray, scaled: np.ndarray, norm: np.ndarray, query: int, e: np.ndarray) -> list[tuple]:
        e = e / np.abs(e).max()
        size = np.sqrt((e * e).sum())
        inner, off = codes.estimate(e / size)
        inner[ids == query] = -np.inf
        lower = inner - off
        least = np.partition(lower, -k)[-k] if len(ids) > k else -np.inf
        near = np.flatnonzero((inner + off >= least) & (ids != query))
        cosine = (scaled[near] * e).sum(axis=1) / (norm[near] * size)
        return [(query, ids[near[i]], cosine[i]) for i in np.lexsort((ids[near], -cosine))[:k]]

    def run(batches):
        at, parts, coded = None, [], None
        for b in batches:
            place, kind, d = (b.column(c).to_numpy() for c in ("place", "kind", "d"))
            out: list[tuple] = []
            cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0) | (np.diff(d) != 0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if i == j:
                    continue
                ids, x = b.column("id").slice(i, j - i).to_numpy(), matrix(b.column("e").slice(i, j - i))
                if (own := (int(place[i]), int(d[i]))) != at:
                    at, parts, coded = own, [], None
                if kind[i] == 0:
                    parts.append((ids, x))
                elif coded is None and parts:
                    all_ids, all_x = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
                    scaled = all_x / np.abs(all_x).max(axis=1, keepdims=True)
                    coded = Codes(all_x, centre.get(at[1], np.zeros(at[1]))), all_ids, scaled, np.sqrt((scaled * scaled).sum(axis=1))
                    parts = []
                if kind[i] == 1 and coded:
                    for query, e in zip(ids.tolist(), x):
                        out += top(*coded, query, e)
            q, v, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of each vector length, over at most CENTRE_ROWS rows (those with the smallest hashes). It is one vector."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_ROWS).select("e").toArrow().combine_chunks()
    if not some.num_rows:
        return {}
    return {d: units(x).mean(axis=0) for d, _, x in by_length(some["e"].chunk(0))}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` by cosine for each row of `queries`.

    A query's own id is no candidate. Ties go to the smaller vec_id. Vectors that are null,
    empty, zero, or hold null or non-finite components, and rows without an id, take no part;
    vectors of another length are no candidates. Rows of `vectors` that share an id are
    candidates each; of queries that share an id the smallest vector counts. Empty tables give
    no rows. Other columns are ignored.

    Each vector goes to one block, and all queries to each block: vectors are the larger table.
    """

    def usable_rows(df: DataFrame) -> DataFrame:
        return df.select("vec_id", F.col("embedding").alias("e")).where(usable(F.col("e")) & F.col("vec_id").isNotNull()).withColumn("d", F.size("e"))

    live = usable_rows(vectors)
    # Of equal vectors only those with the smallest ids can be an answer: k of them, and perhaps the query itself.
    first = F.dense_rank().over(Window.partitionBy("e").orderBy("vec_id"))
    candidates = live.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n")
    asked = usable_rows(queries).groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("d", F.size("e"))
    found = live.count()
    spark = vectors.sparkSession
    n = max(1, -(-found // rows), min(parallelism(spark), -(-found // LEAST_ROWS)))
    left = candidates.select(F.pmod(F.xxhash64("vec_id", "e"), n).cast("int").alias("place"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "d", "e")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "d", "e")
    dealt = left.unionByName(right).repartition(n, "place").sortWithinPartitions("place", "d", "kind", "id")
    best = dealt.mapInArrow(_search(k, centres(live)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
