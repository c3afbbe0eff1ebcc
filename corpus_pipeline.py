"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays,
sources are mixed to target weights, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from tracewright.llm.common import Scratch, table

NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts are scored like others (they hold nothing toxic). Rows that share an id, or
    have none, are judged one by one; repeated rows all stay or all go. Very long texts are scored whole.
    An empty table gives no rows, extra columns go. Without labelled rows every score is the same.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(COLUMNS))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows.

    A null text becomes the empty text. Of a repeated line the document of the largest id keeps all its
    copies; rows that share an id count as one document, rows without an id as one below all others.
    Repeated rows come back as often, very long texts are taken line by line, an empty table gives no rows.
    """
    return _counted(line_dedup.dedup_lines(docs, keep=("lang", "source")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without an id stay.

    Empty and null texts are in no group and stay. Rows that share an id are one document, so they stay
    or go together, repeated rows too. Very long texts are compared whole. An empty table gives no rows.
    """
    groups = ngram_join.join_components(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    copies = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet the target weights of clean and poor ones; no row comes more than once.

    Texts without tokens (null, empty) have the rate of the prior. Rows of one id and text have one rate and
    come or go together; a null id is an id like another. Very long texts count with all tokens. An empty table
    gives no rows; extra columns go.
    """
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.CLEANED, most=1.0)
    return mixing.apply(docs, mixed).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document.

    Null and empty texts have no tokens. Each row has a row here, whatever its id; very long texts are
    encoded whole. An empty table gives no rows.
    """
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, path, P.PATTERN), path)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL: str | None = None  # learned stages have no SQL; tests hold the run against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, "stage")
    return docs
