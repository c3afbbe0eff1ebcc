"""Findings from a stream of trace files.

Every document is whole in itself, so the stream needs no state and no watermark: the batch
plan runs on each micro-batch, and files are read once each by the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..analysis import findings
from ..operators.taxonomy import DEFAULT, Registry
from ..plans.compiler import Pattern
from ..sources.documents import ingest, traces_of


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(trace_id, doc) for each file that arrives in a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("doc"))


def findings_stream(documents: DataFrame, patterns: list[Pattern], taxonomy: Registry = DEFAULT) -> DataFrame:
    """A streaming DataFrame of findings: stateless, so in append mode."""
    return findings(traces_of(ingest(documents)), patterns, taxonomy)


def start(found: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append findings to files, each exactly once."""
    return found.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
