"""Mixing sources to target weights by soft membership, in DataFrame functions only.

1. A naive Bayes classifier learns from the labelled table what the domains look like: the
   tokens that tell domains apart best, with a log-likelihood for each domain.
2. Every document gets a posterior over domains, from all tokens of its whole text.
3. Rates r >= 0 for documents minimise
       sum over domains k of (sum_d r_d * tokens_d * posterior_dk - target_k)^2
   by distributed projected gradient descent from r = 1, each document's step scaled by the
   tokens of its domains, until the totals are met or no step changes them. Only the K domain
   totals and two lengths go to the driver.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, held_out
from .text_features import bounded_sample

# Production parameters. Domains come from the labelled table: (quality, toxic).
DOMAINS = {"clean": "quality = 1 AND toxic = 0", "poor": "quality = 0", "toxic": "quality = 1 AND toxic = 1"}
TARGETS = {"clean": 0.90, "poor": 0.07, "toxic": 0.03}
CLEANED = {d: DOMAINS[d] for d in ("clean", "poor")}  # what is left once toxic documents are gone
MOST_ROWS, VOCABULARY, MIN_SUPPORT = 6_000, 2_048, 5
STEPS, TOLERANCE = 5, 1e-4
STILL, MOST_STEPS = 0.1, 2_000  # done if a step moves less than this share of the tolerance; a larger gap is reported
LEAST_WEIGHT = 1.0
_BLANK = r"[\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """The tokens of a text; no token is empty."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE)), _BLANK)


def sample(docs: DataFrame, labels: DataFrame, domains: dict[str, str], most: int) -> DataFrame:
    """A sample of labelled documents, bounded in rows and bytes: text, k (the domain's place)."""
    place = reduce(lambda out, p: out.when(F.expr(p[1]), p[0]), list(enumerate(domains.values())), F.when(F.lit(False), 0))
    ids = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
        .select("doc_id", place.alias("k")).where("k IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return bounded_sample(docs, ids, most)


def classifier(docs: DataFrame, labels: DataFrame, domains: dict[str, str], scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """A naive Bayes model of which tokens a document holds: at most VOCABULARY tokens (h, w0,
    w1, ...), and each domain's log-likelihood, prior included, of a text that holds none."""
    n = len(domains)
    rows = scratch.save(sample(docs, labels, domains, MOST_ROWS).select("k", F.array_distinct(tokens(F.col("text"))).alias("tokens")), "sample")
    sizes = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = [math.log((sizes.get(k, 0) + 1) / (total + n)) for k in range(n)]
    held = rows.select("k", F.explode("tokens").alias("token")).where("token <> ''").groupBy("token").agg(
        *(F.sum(F.when(F.col("k") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(n)), F.count("*").alias("n")
    )
    rate = [(F.col(f"n{k}") + 0.1) / (sizes.get(k, 0) + 1.0) for k in range(n)]
    present = [F.log(r / (1 - r)) for r in rate]
    mean = reduce(lambda a, b: a + b, present) / n
    weights = [(w - mean).alias(f"w{k}") for k, w in enumerate(present)]
    told = reduce(lambda a, b: F.greatest(a, b), [F.abs(w) for w in weights])
    top = (
        held.where(F.col("n") >= MIN_SUPPORT).select("token", "n", *weights, *(F.log(1 - r).alias(f"a{k}") for k, r in enumerate(rate)), told.alias("told"))
        .where(F.col("told") >= LEAST_WEIGHT).orderBy(F.desc(F.col("told") * F.sqrt("n")), "token").limit(VOCABULARY)
    )
    vocabulary = scratch.save(top.select(F.xxhash64("token").alias("h"), *(f"{x}{k}" for x in "wa" for k in range(n))), "vocabulary")
    absent = vocabulary.agg(*(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)).alias(f"a{k}") for k in range(n))).first()
    return vocabulary.select("h", *(f"w{k}" for k in range(n))), [p + absent[f"a{k}"] for k, p in enumerate(prior)]


def posteriors(docs: DataFrame, vocabulary: DataFrame, base: list[float]) -> DataFrame:
    """doc_id, body (hash of the text), tokens, p (posterior of each domain) for each document.

    `base` holds each domain's log-likelihood of a text without any token of the vocabulary.
    Rows that share id and text are one document here.
    """
    n = len(base)
    split = docs.select("doc_id", F.xxhash64("text").alias("body"), tokens(F.col("text")).alias("t"))
    counted = split.select("doc_id", "body", F.when(F.get("t", F.lit(0)) == "", 0).otherwise(F.size("t")).cast("long").alias("tokens"), F.array_distinct("t").alias("t"))
    # An empty token stands for the text itself, so that texts without a known token stay.
    words = counted.select("doc_id", "body", "tokens", F.explode(F.array_append("t", F.lit(""))).alias("token"))
    own = words.select("doc_id", "body", "tokens", F.xxhash64("token").alias("h"))
    nothing = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"), *(F.lit(0.0).alias(f"w{k}") for k in range(n)))
    # The vocabulary has at most VOCABULARY rows and this one, whatever the input.
    hit = own.join(F.broadcast(vocabulary.unionByName(nothing)), "h")
    summed = hit.groupBy("doc_id", "body").agg(F.max("tokens").alias("tokens"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(n)))
    logit = [F.col(f"w{k}") + p for k, p in enumerate(base)]
    top = reduce(lambda a, b: F.greatest(a, b), logit)
    e = [F.exp(x - top) for x in logit]
    return summed.select("doc_id", "body", "tokens", F.array(*[x / reduce(lambda a, b: a + b, e) for x in e]).alias("p"))


def fit_rates(soft: DataFrame, weights: list[float], scratch: Scratch, most: float | None = None) -> tuple[DataFrame, list[float]]:
    """(soft with `rate`, the targets in tokens). The targets are the largest totals in the given
    proportions that need no domain's expected tokens more than once. Rates are projected to
    0 and above, and to `most` and below where it is given. No document can then make up for a
    scarce domain, so the domain of the largest weight sets the scale and a scarcer one gives all it has."""
    n = len(weights)
    t = [F.col("tokens") * F.get("p", F.lit(k)) for k in range(n)]
    stats = soft.agg(*(F.sum(x).alias(f"t{k}") for k, x in enumerate(t))).first()
    have = [stats[f"t{k}"] or 0.0 for k in range(n)]
    share = [w / sum(weights) for w in weights]
    if missing := [k for k, (h, s) in enumerate(zip(have, share)) if s > 0 and h <= 0]:
        warnings.warn(f"mixing: no tokens at all in domains {missing}, which have weights; the others share all", stacklevel=2)
    sizes = [(s, h / s) for h, s in zip(have, share) if s > 0 and h > 0]
    scale = (min(x for _, x in sizes) if most is None else max(sizes)[1]) if sizes else 0.0
    target = [min(h, scale * s) for h, s in zip(have, share)]
    total = sum(target)
    if not total:
        return soft.withColumn("rate", F.lit(0.0) if sum(have) else F.lit(1.0)), target
    # With A_kd = tokens_d * p_dk, |A x|^2 is at most the sum of tokens_d * curve_d * x_d^2 (Cauchy
    # and Schwarz, domain by domain), so a step of slope / curve never overshoots.
    curve = reduce(lambda a, b: a + b, [F.get("p", F.lit(k)) * h for k, h in enumerate(have)])

    def project(r: Column) -> Column:
        return F.greatest(F.lit(0.0), r) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r))

    state = written = scratch.save(soft.select("*", F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead")), "rates")
    momentum, done, push = 1.0, False, 0.0
    for step in range(MOST_STEPS):
        now = state.agg(*(F.sum(F.col("ahead") * x).alias(f"t{k}") for k, x in enumerate(t))).first()
        gap = [now[f"t{k}"] - target[k] for k in range(n)]
        slope = reduce(lambda a, b: a + b, [F.get("p", F.lit(k)) * g for k, g in enumerate(gap)])
        moved = state.withColumn("next", project(F.when(curve > 0, F.col("ahead") - slope / curve).otherwise(F.col("ahead"))))
        back = F.col("tokens") * curve * (F.col("ahead") - F.col("next"))
        told = moved.agg(F.sum(back * (F.col("ahead") - F.col("next"))).alias("move"), F.sum(back * (F.col("next") - F.col("rate"))).alias("turn"), *(F.sum(F.col("next") * x).alias(f"t{k}") for k, x in enumerate(t))).first()
        off = max(abs(told[f"t{k}"] - target[k]) for k in range(n)) / total
        done = off < TOLERANCE or math.sqrt(told["move"] or 0.0) < STILL * TOLERANCE * total
        if (told["turn"] or 0.0) > 0:  # the momentum points uphill
            momentum = 1.0
        then = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        push, momentum = (momentum - 1) / then, then
        state = moved.withColumn("ahead", project(F.col("next") + (F.col("next") - F.col("rate")) * push)).withColumn("rate", F.col("next")).drop("next")
        if done or (step + 1) % STEPS == 0:
            state = scratch.save(state, "rates")
            scratch.drop(written)
            written = state
        if done:
            break
    if off >= TOLERANCE:
        why = "no rates within the bounds come closer" if done else f"stopped after {MOST_STEPS} steps"
        warnings.warn(f"mixing: totals miss their targets by up to {off:.2e} of all tokens ({why})", stacklevel=2)
    return state.drop("ahead"), target


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document: the rate rounded up or down by the document's own fixed chance."""
    chance = (F.xxhash64(F.lit("mix"), doc_id).bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    return F.floor(rate + chance).cast("int")


def mix(
    docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None, targets: dict[str, float] = TARGETS, most: float | None = None
) -> DataFrame:
    """doc_id, body, tokens, p, rate, copies for each distinct (doc_id, text) of docs.

    Null and empty text has no tokens: its posterior is the prior, and its rate follows. A
    null id is an id like another. Documents with equal posteriors get equal rates; repeated
    rows share one row. Without labels all domains have even priors and no tokens tell them
    apart. Empty docs give no rows. Very long texts count with all their tokens
    (they take no part in fitting the classifier). Other columns are ignored. Domains are DOMAINS unless given;
    with `most` they are CLEANED, as such a mix follows the removal of toxic documents.
    """
    domains = domains or (DOMAINS if most is None else CLEANED)
    scratch = Scratch(docs.sparkSession)
    vocabulary, base = classifier(docs, labels, domains, scratch)
    soft = scratch.save(posteriors(docs, vocabulary, base), "posteriors")
    rated, _ = fit_rates(soft, [targets[d] for d in domains], scratch, most)
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def apply(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with all its columns, each row as often as its copies say."""
    names = docs.columns
    own = mixed.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("copies").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_b", F.xxhash64("text"))
    joined = keyed.join(own, keyed["doc_id"].eqNullSafe(own["_doc"]) & (keyed["_b"] == own["_body"]))
    many = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return many.select(*names)
