"""How well findings meet expectations, over any number of results.

A result row: seq, case_id, pattern_id, family (null when nothing was found), candidates,
expected (null: not scored), actual. Outcomes are grounded, abstain, ungrounded, no-match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexcodec import signed_digits, u128_halves

# Outcomes, strongest first.
OUTCOMES = ("grounded", "abstain", "ungrounded", "no-match")


def rank(outcome: Column) -> Column:
    return reduce(lambda c, p: c.when(outcome == p[1], p[0]), enumerate(OUTCOMES), F.when(F.lit(False), 0))


def strongest(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, candidates, actual: the strongest status of a pattern's candidates."""
    best = F.get(F.array(*map(F.lit, OUTCOMES)), F.min(rank(F.col("status"))))
    return findings.groupBy(*keys).agg(F.count("*").alias("candidates"), best.alias("actual"))


def scored(results: DataFrame) -> DataFrame:
    return results.where(F.col("expected").isNotNull())


def confusion(results: DataFrame) -> DataFrame:
    """expected, actual, n: pairs that occur."""
    return scored(results).groupBy("expected", "actual").agg(F.count("*").alias("n"))


def dense_confusion(results: DataFrame) -> DataFrame:
    """All sixteen cells, zeros included: one row for each expected outcome."""
    spark = results.sparkSession
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(OUTCOMES)], "place int, expected string")
    wide = scored(results).groupBy("expected").pivot("actual", list(OUTCOMES)).count()
    out = F.broadcast(rows).join(wide, "expected", "left")
    return out.select("place", "expected", *(F.coalesce(f"`{o}`", F.lit(0)).cast("long").alias(o.replace("-", "_")) for o in OUTCOMES))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def accuracy_of(matched: Column, n: Column) -> Column:
    return ratio(matched.cast("double"), n.cast("double"))


def scores(results: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn (positive: grounded), precision, recall, f1, total, correct, accuracy."""
    wants, is_ = F.col("expected") == "grounded", F.col("actual") == "grounded"
    counts = scored(results).agg(
        F.count_if(wants & is_).alias("tp"), F.count_if(~wants & is_).alias("fp"), F.count_if(wants & ~is_).alias("fn"),
        F.count_if(~wants & ~is_).alias("tn"), F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("actual")).alias("correct"),
    )
    tp = F.col("tp")
    rated = counts.withColumns(
        {"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "accuracy": ratio(F.col("correct"), F.col("total"))}
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def per_pattern(results: DataFrame) -> DataFrame:
    """pattern_id, runs, passed, candidates, accuracy; `first` orders by first appearance."""
    hit = F.col("expected") == F.col("actual")
    return results.groupBy("pattern_id").agg(
        F.min("seq").alias("first"), F.count("*").alias("runs"), F.count_if(F.col("expected").isNull() | hit).alias("passed"),
        F.sum("candidates").alias("candidates"), accuracy_of(F.count_if(hit), F.count("expected")).alias("accuracy"),
    )


def per_family(results: DataFrame) -> DataFrame:
    """family, runs, passed, accuracy over scored results; a result without candidates has no family and is left out."""
    hit = F.col("expected") == F.col("actual")
    rows = scored(results).where((F.col("candidates") > 0) & F.col("family").isNotNull())
    return rows.groupBy("family").agg(F.min("seq").alias("first"), F.count("*").alias("runs"), F.count_if(hit).alias("passed"), accuracy_of(F.count_if(hit), F.count("*")).alias("accuracy"))


def net_values(calls: DataFrame) -> DataFrame:
    """trace_id, address, net, net_digits: value in less value out. A transfer to oneself nets to nothing.

    The halves of the amounts are summed apart, so totals are exact whatever their size. net_digits has
    them as text, null beyond 128 signed bits; net as a number, null beyond 38 digits.
    """
    high, low = u128_halves(F.col("value_hex"))
    flows = calls.where(F.col("value_hex") != "0" * 32).select("trace_id", "from_addr", "to_addr", high.alias("h"), low.alias("l"))
    move = lambda who, sign: F.struct(F.col(who).alias("address"), (F.col("h") * sign).cast("decimal(21,0)").alias("h"), (F.col("l") * sign).cast("decimal(21,0)").alias("l"))
    moves = flows.select("trace_id", F.inline(F.array(move("to_addr", 1), move("from_addr", -1)))).where("address IS NOT NULL")
    summed = moves.groupBy("trace_id", "address").agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
    digits = signed_digits(F.col("h"), F.col("l"))
    return summed.select("trace_id", "address", digits.alias("net_digits")).select("trace_id", "address", F.expr("try_cast(net_digits AS DECIMAL(38,0))").alias("net"), "net_digits")


def trace_summary(traces: DataFrame) -> DataFrame:
    names = {"calls": "call_count", "storage_changes": "storage_change_count", "logs": "log_count", "token_transfers": "token_transfer_count"}
    return traces.select("trace_id", "tx.tx_hash", "tx.block_number", "tx.chain_id", *(F.size(k).alias(v) for k, v in names.items()))
