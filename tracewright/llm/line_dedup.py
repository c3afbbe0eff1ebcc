"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a bucketed table sorted by a 128-bit line hash: (h1, h2, n_docs, max_doc). A new
batch is merge-anti-joined with the runs: keys that a run already settles (enough documents,
and a larger id than any of the batch) add nothing, the others form a run of their own at
level 0. When a level is full, its runs are compacted into one run of the next level.
Bucketed alike, runs join, merge and compact without another shuffle.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, ascii_lower, parallelism

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
HEAVY = 1024  # keys that hold over one in so many of the repeated lines: fewer than so many keys, whatever the input
HASH = ["h1", "h2"]


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, body (hash of the text), pos, h1, h2 for each line whose key is long enough."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("body"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    ).where(F.octet_length("line") >= min_chars)
    keys = lines.select("doc_id", "body", "pos", F.btrim("line", F.lit(WHITESPACE)).alias("line"))
    keys = keys.where(F.char_length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return keys.select("doc_id", "body", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


class LineRuns:
    """The levels of runs. Each run is a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or parallelism(spark)
        self.scratch = Scratch(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", self.scratch.new_path("run")
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name, path

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Merge-join the runs pairwise: counts add up, the larger id stays. Bucketed alike, they need no shuffle."""
        both = [F.coalesce(F.col("a.n_docs"), F.lit(0)) + F.coalesce(F.col("b.n_docs"), F.lit(0)), F.greatest("a.max_doc", "b.max_doc")]

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.alias("a").join(b.alias("b"), HASH, "full").select(*HASH, both[0].alias("n_docs"), both[1].alias("max_doc"))

        return reduce(merge, [self.spark.table(name) for name, _ in runs])

    @property
    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch: rows of doc_id, h1, h2, one for each document and key."""
        own = keys.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        for name, _ in self.runs:
            run = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).alias("run")
            own = own.alias("own").join(
                run,
                [F.col("own.h1") == F.col("run.h1"), F.col("own.h2") == F.col("run.h2"), F.col("run.max_doc") >= F.col("own.max_doc")],
                "left_anti",
            )
        self._push(0, self._write(own))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            self._forget(old)
            self._push(level + 1, merged)

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.remove(path)

    def compact(self) -> DataFrame:
        """All runs as one; returns the keys that enough documents hold."""
        if len(self.runs) > 1:
            old = self.runs
            self.levels = [[], [self._write(self._merged(old))]]
            self._forget(old)
        return self._merged(self.runs).where(F.col("n_docs") >= self.min_docs)

    def drop(self) -> None:
        """Forget all runs."""
        self._forget(self.runs)
        self.levels = []


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """The documents in n ranges of ids, the largest ids first; null ids go with the smallest."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] if n > 1 else None
    if not cuts:
        return [docs]
    cuts = sorted(set(cuts), reverse=True)
    out = [docs.where(F.col("doc_id") >= cuts[0])]
    out += [docs.where((F.col("doc_id") < hi) & (F.col("doc_id") >= lo)) for hi, lo in zip(cuts, cuts[1:])]
    return [*out, docs.where((F.col("doc_id") < cuts[-1]) | F.col("doc_id").isNull())]


def _dropped(docs: DataFrame, runs: LineRuns, min_chars: int, batches: int) -> DataFrame:
    """doc_id, body, gone (places of the lines that go) for texts that lose any; all batches are added to `runs`."""
    for part in _batches(docs, batches):
        runs.add(line_keys(part, min_chars).select("doc_id", *HASH).distinct())  # a document holds a key once
    hot = runs.compact()
    # Lines of the few heaviest keys find them by broadcast. They go through the join below with keys
    # that match nothing and differ from line to line, so that no task gets all lines of a key.
    total = hot.agg(F.sum("n_docs")).first()[0] or 0
    heavy = hot.where(F.col("n_docs") * HEAVY > total).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("max_doc").alias("top"))
    lines = line_keys(docs, min_chars)
    lines = lines.join(F.broadcast(heavy), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    spread = F.when(F.col("top").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "body", "pos"))
    lines = lines.select("doc_id", "body", "pos", "top", spread.alias("h1"), F.when(F.col("top").isNull(), F.col("h2")).alias("h2"))
    last = F.coalesce("top", "max_doc")
    return (
        lines.join(hot, HASH, "left")
        .where(last.isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < last)))
        .groupBy("doc_id", "body")
        .agg(F.collect_set("pos").alias("gone"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines, n_dropped and the columns `keep`, for each row.

    A line whose key at least `min_docs` documents hold stays only in the document with the
    largest id that holds it (there, all its copies stay). Rows that share an id count as one
    document but are returned one by one; all rows without an id count as one document, with
    an id below any other. Null and empty text is one empty line; of very long texts every
    line counts. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *keep).alias("rest"))
    runs = LineRuns(spark, min_docs)
    try:
        gone = runs.scratch.save(_dropped(docs, runs, min_chars, batches), "gone")
    finally:
        runs.drop()
    whole = docs.withColumn("body", F.xxhash64("text")).alias("d")
    joined = whole.join(
        gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.body") == F.col("g.body")), "left"
    ).select("d.doc_id", "d.text", "d.rest", "g.gone")
    all_lines = split_lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return joined.withColumn("lines", all_lines).select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        *(F.col("rest").getField(c).alias(c) for c in keep),
    )
