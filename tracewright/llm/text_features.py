"""Hashed word n-gram features, a follow-the-regularised-leader learner, and the bounded training sample."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN_CLASS, held_out, mix, pieces, text_buffer, word_columns

_U = np.uint64
MOST_BYTES, LONGEST = 64 << 20, 1 << 20  # bounds of a sample: bytes of all its texts, and of one text in it


def token_slices(column: pa.Array, fold: bool, stems: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of rows: the first row, token hashes (one column, and one for each stem) and token
    offsets. Tokens are runs of letters and digits, or of signs."""
    data, offsets = text_buffer(column)
    for i, j in pieces(offsets):
        h, w = word_columns(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TOKEN_CLASS, fold, stems)
        yield i, h, w


def ngrams(h: np.ndarray, w: np.ndarray, bits: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigram and bigram features: feature index and row, for each occurrence.

    With `same`, a bigram of one token twice is the feature "again", whatever the token.
    """
    row = np.repeat(np.arange(len(w) - 1), np.diff(w))
    pair = row[1:] == row[:-1]
    two = mix(h[:-1] * _U(3) + h[1:])
    if same:
        two = np.where(h[:-1] == h[1:], mix(np.full(1, 0xA6A1, np.uint64))[0], two)
    shift = _U(64 - bits)
    return np.concatenate([h >> shift, (two >> shift)[pair]]).astype(np.int64), np.concatenate([row, row[1:][pair]])


def sparse(index: np.ndarray, row: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, feature) pairs: row starts, features, counts."""
    key, count = np.unique((row.astype(np.int64) << bits) | index, return_counts=True)
    return np.searchsorted(key >> bits, np.arange(n + 1)), key & ((1 << bits) - 1), count


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal for logistic loss. Defaults suit a few thousand examples."""

    bits: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 4

    def fit(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray | None, y: np.ndarray) -> np.ndarray:
        """Weights; the last one is the bias. Without values all are 1. y: labels, or probabilities, from 0 to 1. The bias starts from their mean."""
        n = (1 << self.bits) + 1
        mean = np.clip(y.mean(), 0.01, 0.99)
        prior = np.log(mean / (1 - mean))
        z, s = np.zeros(n), np.zeros(n)

        def weights(f, l1):
            return np.where(np.abs(z[f]) <= l1, 0.0, -(z[f] - np.sign(z[f]) * l1) / ((self.beta + np.sqrt(s[f])) / self.alpha + self.l2))

        bias = np.array([n - 1])
        for _ in range(self.epochs):
            for i in range(len(y)):
                f = index[starts[i] : starts[i + 1]]
                x = np.ones(len(f)) if value is None else value[starts[i] : starts[i + 1]]
                w, b = weights(f, self.l1), weights(bias, 0.0)
                g = 1 / (1 + np.exp(-np.clip(w @ x + b[0] + prior, -35, 35))) - y[i]
                for k, wk, gk in ((f, w, g * x), (bias, b, np.array([g]))):
                    more = np.sqrt(s[k] + gk * gk)
                    z[k] += gk - (more - np.sqrt(s[k])) / self.alpha * wk
                    s[k] += gk * gk
        every = np.arange(n)
        out = weights(every, self.l1)
        out[-1] = weights(bias, 0.0)[0] + prior
        return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, y of at most `most` labelled ids of `docs` outside the held-out fold, those with the smallest hashes.

    Labels that are null, or that contradict each other for one id, or of documents that aren't there, are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("top"))
        .where("y = top")
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", F.col("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def bounded_sample(docs: DataFrame, ids: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES, longest: int = LONGEST) -> DataFrame:
    """place, text and the other columns of `ids` (few rows, one for each id) for a sample of docs.

    Bounded in rows and bytes whatever the input: of the distinct pairs of id and text, without
    texts of over `longest` bytes, those with the smallest hashes, `most_rows` of them and
    `most_bytes` in all. Neither order nor partitions change it. `place` numbers them from 1.
    """
    rest = [c for c in ids.columns if c != "doc_id"]
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    own = own.withColumn("body", F.xxhash64("text"))
    order = [F.xxhash64("doc_id", "body"), F.col("doc_id"), F.col("body")]
    some = own.select("doc_id", "body", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).distinct().orderBy(*order).limit(most_rows)
    upto = Window.orderBy(*order)  # over `most_rows` short rows at most
    placed = some.select("doc_id", "body", F.row_number().over(upto).alias("place"), F.sum("bytes").over(upto).alias("upto"))
    chosen = placed.where(F.col("upto") <= most_bytes).select("doc_id", "body", "place")
    rows = own.join(F.broadcast(chosen), ["doc_id", "body"])
    return rows.groupBy("place").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in rest))


def learn(rows: DataFrame, learner: Ftrl) -> dict[str, np.ndarray]:
    """The learner's weights from compact feature rows: place, y, index (array<int>) and, if there is one, value (array<float>).

    Features are made in many tasks; only they go to the one task that takes its steps in order of place.
    Without rows all weights are 0.
    """
    names = [c for c in ("place", "y", "index", "value") if c in rows.columns]

    def run(batches):
        y, sizes, index, value = [], [np.zeros(1, np.int64)], [], []
        for b in batches:
            y.append(b.column("y").to_numpy().astype(float))
            sizes.append(pa.compute.list_value_length(b.column("index")).to_numpy(zero_copy_only=False).astype(np.int64))
            index.append(b.column("index").flatten().to_numpy())
            if "value" in names:
                value.append(b.column("value").flatten().to_numpy())
        out, y = io.BytesIO(), np.concatenate([np.zeros(0), *y])
        weights = np.zeros(1)
        if len(y):
            starts, flat = np.cumsum(np.concatenate(sizes)), np.concatenate(index)
            index.clear()  # one copy is enough
            weights = learner.fit(starts, flat, np.concatenate(value) if value else None, y)
        feature = np.flatnonzero(weights[:-1])
        np.savez(out, feature=feature, weight=weights[[*feature, -1]])
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    row = rows.select(*names).repartition(1).sortWithinPartitions("place").mapInArrow(run, "model binary").first()
    if row is None:
        return {"feature": np.zeros(0, np.int64), "weight": np.zeros(1)}
    got = np.load(io.BytesIO(bytes(row["model"])))
    return {k: got[k] for k in got.files}


def dense(model: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """All weights, the bias last."""
    out = np.zeros((1 << bits) + 1, np.float32)
    out[model["feature"]], out[-1] = model["weight"][:-1], model["weight"][-1]
    return out


def lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from row starts and flat values."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))
