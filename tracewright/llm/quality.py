"""Quality classifier: hashed word n-gram logistic regression, FTRL updates, scores as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .text_features import Ftrl, bounded_sample, dense, labelled, learn, lists, ngrams, sparse, token_slices

BITS, MOST_ROWS, THRESHOLD, SCALE = 18, 8_000, 0.7, 8.0


def features(column: pa.Array, bits: int = BITS):
    """For groups of rows: first row, row starts, features, values. A row's vector is log(1 + count), at fixed length."""
    for first, h, w in token_slices(column, fold=False):
        n = len(w) - 1
        index, row = ngrams(h[:, 0], w, bits, same=True)
        starts, feature, count = sparse(index, row, bits, n)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(np.repeat(np.arange(n), np.diff(starts)), value * value, n))
        yield first, starts, feature, value * np.repeat(SCALE / np.maximum(norm, 1e-12), np.diff(starts))


def featured(sample: DataFrame, bits: int = BITS) -> DataFrame:
    """place, y, index, value: the features of each document of a sample."""

    def run(batches):
        for b in batches:
            for first, starts, f, v in features(b.column("text"), bits):
                own = b.slice(first, len(starts) - 1)
                columns = [own.column("place"), own.column("y"), lists(starts, f.astype(np.int32), pa.int32()), lists(starts, v.astype(np.float32), pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, ["place", "y", "index", "value"])

    return sample.select("place", "y", "text").mapInArrow(run, "place int, y int, index array<int>, value array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, bits: int = BITS) -> dict[str, np.ndarray]:
    """Weights from at most `most_rows` labelled documents outside the held-out fold; zeros if there are none."""
    scratch = Scratch(docs.sparkSession)
    sample = bounded_sample(docs, labelled(docs, labels, label, most_rows), most_rows)
    return learn(scratch.save(featured(sample, bits), "features"), Ftrl(bits))


def score(docs: DataFrame, model: dict[str, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id, score for each row, over the whole text. Null and empty text scores as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = dense(shared.value, bits)
        for b in batches:
            out = np.zeros(b.num_rows)
            for first, starts, f, v in features(b.column("text"), bits):
                n = len(starts) - 1
                out[first : first + n] = np.bincount(np.repeat(np.arange(n), np.diff(starts)), w[f] * v, n)
            p = 1 / (1 + np.exp(-np.clip(out + w[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null text is empty text; a null id is not held out; repeated rows are scored each, and equal
    texts get equal scores. Very long texts are scored whole, a slice at a time; those of over
    LONGEST bytes take no part in the training. An empty table gives no rows; with no labelled
    rows every score is 0.5. Other columns, lang and source among them, are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
