"""Toxicity by weak supervision.

Voters look at a bounded sample of labelled documents outside the held-out fold. They differ
in kind: seed lexicons, phrase patterns, mined words, mined stems of three lengths, and
repetition. A generative label model estimates, by expectation maximisation, how often each
voter fires on toxic and on clean documents, and which other voter it goes with: given the
label, voters form a tree of dependences, so that a voter that only repeats another adds
nothing. The posterior labels train a linear classifier over hashed words and stems, which
scores every document.

Labels serve in two places only: the share of toxic documents, and the mining of lexicons
(the corpus has languages for which there are no seeds).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKEN_CLASS, Scratch, hash_words, held_out, mix
from .text_features import Ftrl, bounded_sample, dense, labelled, learn, lists, sparse, token_slices

BITS, MOST_ROWS, THRESHOLD = 20, 12_000, 0.3
STEMS = (4, 5, 6)  # bytes: inflected forms share the start of the word
MIN_SUPPORT, MIN_LIFT, MIN_FORMS, RUN, LEAN = 4, 40.0, 3, 8, 1.0

# Small seed lexicons of common English insults, by kind, and phrase patterns.
LEXICONS = {
    "insult": "idiot moron stupid fool imbecile dumb",
    "contempt": "scum trash garbage filth vermin worthless",
    "belittling": "loser pathetic clown disgusting coward",
}
PATTERNS = {
    "second_person": ["you are a", "you are an", "you are such", "you are so", "shut up"],
    "threat": ["kill you", "hurt you", "hate you", "go die", "i will find you"],
}
VOTERS = [*LEXICONS, *PATTERNS, "mined_words", *(f"mined_stems_{k}" for k in STEMS), "several_words", "repetition"]


def _phrases() -> dict[int, np.ndarray]:
    """Pattern phrases by length, as hashes of token sequences."""
    out: dict[int, list] = {}
    for name, phrases in PATTERNS.items():
        for p in phrases:
            h = hash_words(p, TOKEN_CLASS)
            out.setdefault(len(h), []).append((name, _sequence(h, len(h))[0]))
    return out


def _sequence(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(3) + h[k : len(h) - n + 1 + k])
    return out


def votes(h: np.ndarray, w: np.ndarray, mined: list[np.ndarray]) -> np.ndarray:
    """One row for each text, one column for each of VOTERS: does it fire? mined: words, and stems of each length."""
    n = len(w) - 1
    row = np.repeat(np.arange(n), np.diff(w))
    word = h[:, 0]
    seeds = [hash_words(x, TOKEN_CLASS) for x in LEXICONS.values()]

    def fires(hit: np.ndarray) -> np.ndarray:
        return np.bincount(row[hit], minlength=n) > 0

    lexicons = [fires(np.isin(word, lex)) for lex in seeds]
    fired = {name: np.zeros(n, bool) for name in PATTERNS}
    for length, phrases in _phrases().items():
        if len(word) >= length:
            seq, inside = _sequence(word, length), row[: len(word) - length + 1] == row[length - 1 :]
            for name, code in phrases:
                fired[name] |= np.bincount(row[: len(seq)][(seq == code) & inside], minlength=n) > 0
    hits = [np.isin(word, mined[0]), *(np.isin(h[:, k], mined[k]) for k in range(1, h.shape[1]))]
    told = np.isin(word, np.concatenate([*seeds, mined[0]]))
    words_in_row = np.unique(np.stack([row[told].astype(np.uint64), word[told]], axis=1), axis=0)
    several = np.bincount(words_in_row[:, 0].astype(np.int64), minlength=n) > 1
    again = np.bincount(row[told], minlength=n) > np.bincount(words_in_row[:, 0].astype(np.int64), minlength=n)
    return np.stack([*lexicons, *fired.values(), *map(fires, hits), several, again], axis=1)


def present(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words and stems, and their rows."""
    row = np.repeat(np.arange(len(w) - 1), np.diff(w))
    there = h != 0
    return h[there], np.broadcast_to(row[:, None], h.shape)[there]


def least_runs(h: np.ndarray, w: np.ndarray, n: int = RUN) -> np.ndarray:
    """The smallest hash of n words in a row of each text, which near copies share."""
    runs = _sequence(h[:, 0], n) if len(h) >= n else np.zeros(0, np.uint64)
    least = [runs[a : b - n + 1].min() if b - a >= n else mix(h[a:b, 0]).sum(dtype=np.uint64) for a, b in zip(w[:-1], w[1:])]
    return np.array(least, np.uint64)


def _over_texts(rows: DataFrame, names: tuple[str, ...], schema: str, of) -> DataFrame:
    """An Arrow pass over texts, slice by slice: of(part of the batch, token hashes, token offsets) gives arrays in the schema's order."""
    made = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for first, h, w in token_slices(b.column("text"), True, STEMS):
                yield pa.RecordBatch.from_arrays(of(b.slice(first, len(w) - 1), h, w), made)

    return rows.select(*names, "text").mapInArrow(run, schema)


def _counts(code: np.ndarray, row: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts (rows) that hold each of n codes."""
    pair = np.unique(code.astype(np.int64) * len(y) + row)
    bad = np.bincount(pair // len(y), y[pair % len(y)], n).astype(np.int64)
    return bad, np.bincount(pair // len(y), minlength=n) - bad


def mine(sample: DataFrame) -> list[np.ndarray]:
    """Words that toxic documents hold far more often than clean ones, and the stems, of each length, that several such words share.

    sample: place, y, text. Near copies count once. All counts are groupings; what comes home
    are the telling words and stems, each of them in MIN_SUPPORT of the sample's documents.
    """
    first = _over_texts(sample, ("place",), "place int, least long", lambda b, h, w: [b.column("place"), pa.array(least_runs(h, w).view(np.int64))])
    rows = sample.join(F.broadcast(first.groupBy("least").agg(F.min("place").alias("place")).select("place")), "place")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()

    def telling(counts: DataFrame) -> Column:
        lift = (F.col("bad") / (size["bad"] + 1)) / ((F.col("clean") + 0.5) / (size["n"] - size["bad"] + 1))
        return (F.col("bad") >= MIN_SUPPORT) & (lift >= MIN_LIFT)

    def word_counts(b: pa.RecordBatch, h: np.ndarray, w: np.ndarray) -> list[pa.Array]:
        word, at, code = np.unique(h[:, 0], return_index=True, return_inverse=True)
        bad, clean = _counts(code, np.repeat(np.arange(b.num_rows), np.diff(w)), b.column("y").to_numpy(), len(word))
        stems = lists(np.arange(len(word) + 1) * len(STEMS), h[at, 1:].ravel().view(np.int64), pa.int64())
        return [pa.array(word.view(np.int64)), stems, pa.array(bad), pa.array(clean)]

    sums = [F.sum(c).alias(c) for c in ("bad", "clean")]
    counted = _over_texts(rows, ("y",), "word long, stems array<long>, bad long, clean long", word_counts).groupBy("word").agg(F.first("stems").alias("stems"), *sums)
    found = counted.where(telling(counted)).select("word", "stems").collect()
    forms: dict[tuple[int, int], int] = {}
    for r in found:
        for k, stem in enumerate(r["stems"]):
            if stem:
                forms[k, stem] = forms.get((k, stem), 0) + 1
    likely = [np.sort(np.array([s for (j, s), n in forms.items() if j == k and n >= MIN_FORMS], np.int64).view(np.uint64)) for k in range(len(STEMS))]

    def stem_counts(b: pa.RecordBatch, h: np.ndarray, w: np.ndarray) -> list[pa.Array]:
        row, y, parts = np.repeat(np.arange(b.num_rows), np.diff(w)), b.column("y").to_numpy(), []
        for k, stems in enumerate(likely):
            hit = np.isin(h[:, k + 1], stems)
            parts.append((np.full(len(stems), k, np.int32), stems, *_counts(np.searchsorted(stems, h[hit, k + 1]), row[hit], y, len(stems))))
        k, stem, bad, clean = map(np.concatenate, zip(*parts))
        return [pa.array(k), pa.array(stem.view(np.int64)), pa.array(bad), pa.array(clean)]

    stems = _over_texts(rows, ("y",), "k int, stem long, bad long, clean long", stem_counts).groupBy("k", "stem").agg(*sums)
    kept = stems.where(telling(stems)).select("k", "stem").collect()
    hashes = [[r["word"] for r in found], *([r["stem"] for r in kept if r["k"] == k] for k in range(len(STEMS)))]
    return [np.sort(np.array(x, np.int64).view(np.uint64)) for x in hashes]


def _tree(v: np.ndarray, w: np.ndarray) -> list[int]:
    """For each voter the one that it depends on (-1 for the first): the spanning tree of the largest mutual information, rows weighing w."""
    n, total = v.shape[1], w.sum() + 1e-9
    both = v.T @ (v * w[:, None]) / total
    one, gain = np.diag(both), np.zeros((n, n))
    for joint, x, y in (
        (both, one, one), (one[:, None] - both, one, 1 - one), (one[None, :] - both, 1 - one, one), (1 - one[:, None] - one[None, :] + both, 1 - one, 1 - one),
    ):
        joint, even = np.maximum(joint, 1e-12), np.maximum(x[:, None] * y[None, :], 1e-12)
        gain += joint * np.log(joint / even)
    up, best, of, left = [-1] * n, gain[0].copy(), [0] * n, set(range(1, n))
    while left:
        j = max(sorted(left), key=lambda x: best[x])
        up[j] = of[j]
        left.remove(j)
        for x in left:
            if gain[j, x] > best[x]:
                best[x], of[x] = gain[j, x], j
    return up


def label_model(v: np.ndarray, prior: float, count: np.ndarray | None = None, rounds: int = 50, tree: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of each row of votes (each standing for `count` documents), and what was estimated.

    Expectation maximisation of P(votes, label) = P(label) * product of P(vote | vote of its
    parent in the tree, label). The tree is the one of toxic documents (voters fire too rarely on
    clean ones to tell), and what a parent says leans to the voter's own rate as LEAN documents
    would have it. Without `tree` all voters are independent given the label. Returned with it: rates of firing on toxic and clean documents (accuracies follow from
    them), each voter's parent, and its correlation with the parent given the label.
    """
    v = np.asarray(v, float)
    count = np.ones(len(v)) if count is None else np.asarray(count, float)
    post = np.where(v.any(axis=1), 0.9, 0.02)
    n, floor = v.shape[1], (prior, 0.01)  # what a voter's rate leans to, in documents
    up = [-1] * n
    for _ in range(rounds):
        weights = [count * post, count * (1 - post)]
        up = _tree(v, weights[0]) if tree and n > 1 else up
        logs, rates, together = [], [], np.zeros(n)
        for w, lean in zip(weights, floor):
            total = w.sum()
            rate = np.clip((w @ v + lean) / (total + 2 * lean + 1), 1e-5, 0.999)
            rates.append(rate)
            log = np.zeros(len(v))
            for j in range(n):
                if up[j] < 0:
                    p = np.full(len(v), rate[j])
                else:
                    above = v[:, up[j]]
                    given = [((w * m) @ v[:, j] + LEAN * rate[j]) / ((w * m).sum() + LEAN) for m in (1 - above, above)]
                    p = np.clip(np.where(above > 0, given[1], given[0]), 1e-5, 1 - 1e-5)
                    together[j] += (given[1] - given[0]) * total / count.sum()
                log += np.where(v[:, j] > 0, np.log(p), np.log(1 - p))
            logs.append(log)
        logit = np.log(prior / (1 - prior)) + logs[0] - logs[1]
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, {"toxic": rates[0], "clean": rates[1], "parent": np.array(up), "with_parent": together}


def _mask(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (1 << np.arange(v.shape[1], dtype=np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS, bits: int = BITS) -> dict[str, np.ndarray]:
    """Weights of the linear classifier.

    Votes and features of the sample are made in many tasks. What comes home is how many
    documents have each pattern of votes; the label model is fitted on that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sample = scratch.save(bounded_sample(docs, labelled(docs, labels, label, most_rows), most_rows), "sample")
    shared = spark.sparkContext.broadcast(mine(sample))

    def featured(b: pa.RecordBatch, h: np.ndarray, w: np.ndarray) -> list[pa.Array]:
        flat, row = present(h, w)
        starts, f, _ = sparse((flat >> np.uint64(64 - bits)).astype(np.int64), row, bits, b.num_rows)
        return [b.column("place"), b.column("y"), pa.array(_mask(votes(h, w, shared.value))), lists(starts, f.astype(np.int32), pa.int32())]

    rows = scratch.save(_over_texts(sample, ("place", "y"), "place int, y int, votes long, index array<int>", featured), "features")
    seen = rows.groupBy("votes").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).orderBy("votes").collect()  # at most a row for each document of the sample
    mask, n = np.array([r["votes"] for r in seen], np.int64), np.array([r["n"] for r in seen], float)
    share = min(0.5, max(0.005, sum(r["bad"] for r in seen) / max(1, n.sum())))
    post = label_model((mask[:, None] >> np.arange(len(VOTERS))) & 1, share, n)[0] if len(mask) else mask
    judged = spark.createDataFrame([(int(m), float(p)) for m, p in zip(mask, post)], "votes long, p double")
    return learn(rows.join(F.broadcast(judged), "votes").select("place", F.col("p").alias("y"), "index"), Ftrl(bits, alpha=0.5, l1=1.0, l2=0.01, epochs=5))


def scorer(model: dict[str, np.ndarray], bits: int = BITS):
    """A function of an Arrow text column: probability that each text is toxic, over its whole length."""
    weights = dense(model, bits)

    def run(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, h, w in token_slices(texts, True, STEMS):
            n = len(w) - 1
            h, row = present(h, w)
            f = (h >> np.uint64(64 - bits)).astype(np.int64)
            used = weights[f] != 0
            starts, f, _ = sparse(f[used], row[used], bits, n)
            out[first : first + n] = np.bincount(np.repeat(np.arange(n), np.diff(starts)), weights[f], n)
        return 1 / (1 + np.exp(-np.clip(out + weights[-1], -500, 500)))

    return run


def score(docs: DataFrame, model: dict[str, np.ndarray], bits: int = BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and the score. Null and empty text scores as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches):
        of = None
        for b in batches:
            of = of or scorer(shared.value, bits)
            arrays = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(of(b.column("text")))], [*keep, "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null text is empty text; a null id is not held out; repeated rows are scored each, and equal
    texts get equal scores. Very long texts are scored whole, a slice at a time; those of over
    LONGEST bytes take no part in the training. An empty table gives no rows; with no labelled
    rows every score is 0.5. Other columns, lang and source among them, are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
