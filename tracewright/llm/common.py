"""Shared plumbing: the scratch folder, text buffers and vectorised word hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one if all runs on one machine; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tracewright-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They live in the shared folder and go when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/tracewright/{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.new_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def free_shuffles(self) -> None:
        """Let the driver notice that the shuffle files of finished steps are of no more use."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() made and that no later plan reads."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self.remove(folder)


BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Let whole documents go to Python by the thousand at most: Spark's 10,000 texts at once would take hundreds of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- columns


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """The fold that no learner sees: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- text buffers

SLICE_BYTES = 1 << 20


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- word hashes

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LONG_WORD = 64

WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
TOKEN_CLASS = WORD_CLASS.copy()
for _b in range(0x21, 0x80):
    if not chr(_b).isalnum():
        TOKEN_CLASS[_b] = 2
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _tables[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[size]


def _hash_slice(data: np.ndarray, first: np.ndarray, classes: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice; `first`: offsets at which a new text begins. With
    stems, one more column for each: the hash of a word's first so many bytes, 0 if it has no more."""
    kind = classes[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros((0, 1 + len(stems)), np.uint64)
    cut = np.empty(len(kind) + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[first] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    length = ends - starts
    out = mix((prefix[ends] - prefix[starts]) * down[starts] + length.astype(np.uint64))
    if (length > LONG_WORD).any():
        import xxhash

        for i in np.flatnonzero(length > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    columns = [out]
    for size in stems:
        stem = starts + np.minimum(length, size)
        h = mix((prefix[stem] - prefix[starts]) * down[starts] + _U(size << 32))
        columns.append(np.where(length > size, h, _U(0)))
    return starts, np.stack(columns, axis=1)


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD_CLASS, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of word_columns() without stems, in one dimension, and the word offsets."""
    h, w = word_columns(data, offsets, classes, fold)
    return h[:, 0], w


def word_columns(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD_CLASS, fold: bool = True, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and the n + 1 word offsets of the texts.

    A word is a run of bytes of one non-zero class; with `fold`, A-Z count as a-z. The hash
    is a polynomial over random byte values, mixed; words of over 64 bytes take xxh3, so
    that no structured long word can collide. Long texts are taken in slices cut at
    white space, so that temporary arrays stay small.
    """
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in pieces(offsets):
        at, end = int(offsets[i]), int(offsets[j])
        if j - i > 1 or end - at <= 2 * SLICE_BYTES:
            part = FOLD[data[at:end]] if fold else data[at:end]
            first = offsets[i:j] - at
            starts, h = _hash_slice(part, first, classes, stems)
            counts[i:j] = np.diff(np.searchsorted(starts, np.append(first, end - at)))
            out.append(h)
            continue
        while at < end:
            stop = min(at + SLICE_BYTES, end)
            while stop < end:  # on to the next white space
                gap = np.flatnonzero(classes[data[stop : stop + 4096]] == 0)
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(stop + 4096, end)
            part = FOLD[data[at:stop]] if fold else data[at:stop]
            h = _hash_slice(part, np.zeros(1, np.int64), classes, stems)[1]
            counts[i] += len(h)
            out.append(h)
            at = stop
    h = np.concatenate(out) if out else np.zeros((0, 1 + len(stems)), np.uint64)
    return h, np.concatenate([[0], np.cumsum(counts)])


def hash_words(text: str, classes: np.ndarray = WORD_CLASS, fold: bool = True) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), classes, fold)[0]
