import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing, quality, toxicity
from tracewright.llm.common import WORD_CLASS, hash_words, held_out, words
from tracewright.llm.text_features import Ftrl, bounded_sample, labelled

from .conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text, good, bad = prose(rng, rng.randint(20, 80)), 1, 0
        if i % 5 == 0:
            text, good = " | ".join(text.upper().split()) + " !!!", 0
        elif i % 7 == 0:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "zorgling", "zorgler", "zorgful", "zorgs", "snarfed", "snarfy", "snarfing"]))
            text, bad = " ".join(w), 1
        rows.append((i, text))
        labels.append((i, good, bad))
    return rows, labels


ODD = [(5000, None), (5001, ""), (5002, " \n"), (5003, prose(random.Random(1), 40_000)), (None, "idiot"), (7, "idiot scum")]


def test_word_hashes():
    rng = random.Random(0)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(40)] + ["", "A b\tC\x0bd", "x" * 500, "é" * 40 + " é"]
    data, offsets = b"".join(t.encode() for t in texts), np.cumsum([0] + [len(t.encode()) for t in texts])
    h, w = words(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        own = [hash_words(x)[0] for x in t.split()]
        assert h[w[i] : w[i + 1]].tolist() == own
    assert hash_words("ABC")[0] == hash_words("abc")[0] and hash_words("É")[0] != hash_words("é")[0]
    long = prose(rng, 600_000)
    assert len(hash_words(long)) == 600_000 and hash_words(long)[-1] == hash_words(long.split()[-1])[0]
    assert len(hash_words("z" * 3_000_000)) == 1 and WORD_CLASS[0x20] == 0


def test_held_out_fold(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", held_out(df.doc_id).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    y = (np.arange(400) % 2).astype(float)
    index = np.concatenate([[int(v), *rng.integers(2, 64, 3)] for v in y])
    w = Ftrl(6).fit(np.arange(401) * 4, index, np.ones(1600), y)
    assert w[1] > 1 and w[0] < -1 and len(w) == 65


@pytest.mark.parametrize("op, column", [(quality, 1), (toxicity, 2)])
def test_classifiers(spark, documents, op, column):
    rows, labels = corpus(900)
    docs, table = documents(rows + ODD), spark.createDataFrame([*labels, labels[0], (None, 1, 1), (1, 1, None), (9999, 0, 1)], LABELS)
    got = op.classify(docs, table).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = {x[0]: x[column] for x in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 5000]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 40 and right / len(held) > 0.9, (right, len(held))
    again = {(r["doc_id"], r["score"]) for r in op.classify(docs.repartition(7), table).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    nothing = op.classify(docs, table.where("false")).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert op.classify(docs.where("false"), table).count() == 0


def test_held_out_labels_are_never_read(spark, documents):
    rows, labels = corpus(120)
    hidden = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    for op in (quality, toxicity):
        a, b = (sorted((r["doc_id"], r["score"]) for r in op.classify(documents(rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, hidden))
        assert a == b


def plain_em(v, prior, rounds):
    """Independent voters, one document at a time."""
    post = [0.9 if any(row) else 0.02 for row in v]
    for _ in range(rounds):
        n1, n0 = sum(post), len(v) - sum(post)
        r1 = [min(0.999, max(1e-5, (sum(p for p, row in zip(post, v) if row[j]) + prior) / (n1 + 2 * prior + 1))) for j in range(len(v[0]))]
        r0 = [min(0.999, max(1e-5, (sum(1 - p for p, row in zip(post, v) if row[j]) + 0.01) / (n0 + 1.02))) for j in range(len(v[0]))]
        post = []
        for row in v:
            odds = prior / (1 - prior)
            for j, fired in enumerate(row):
                odds *= r1[j] / r0[j] if fired else (1 - r1[j]) / (1 - r0[j])
            post.append(odds / (1 + odds))
    return post, r1, r0


def test_label_model():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    fire = np.array([[0.7, 0.01], [0.5, 0.02], [0.4, 0.001], [0.01, 0.01]])
    v = rng.random((3000, 4)) < np.where(y[:, None], fire[:, 0], fire[:, 1])
    post, model = toxicity.label_model(v, 0.2)
    assert ((post > 0.5) == y)[v[:, :3].any(axis=1)].mean() > 0.85
    assert np.abs(model["toxic"][:3] - fire[:3, 0]).max() < 0.15
    # Without dependences it is plain expectation maximisation; patterns with counts stand for their rows.
    plain, r1, r0 = plain_em(v.tolist(), 0.2, 20)
    alone, model = toxicity.label_model(v, 0.2, rounds=20, tree=False)
    assert np.allclose(alone, plain) and np.allclose(model["toxic"], r1) and np.allclose(model["clean"], r0)
    patterns, which, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    grouped, _ = toxicity.label_model(patterns, 0.2, count)
    assert np.allclose(grouped[which.ravel()], post)


def test_a_voter_that_repeats_another_adds_nothing():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    v = rng.random((4000, 5)) < np.where(y[:, None], [0.6, 0.5, 0.4, 0.5, 0.5], 0.05)
    once, _ = toxicity.label_model(v, 0.2)
    thrice = np.column_stack([v, v[:, 0], v[:, 0]])
    tree, model = toxicity.label_model(thrice, 0.2)
    independent, _ = toxicity.label_model(thrice, 0.2, tree=False)
    assert np.abs(once - tree).mean() < 0.01 < 0.05 < np.abs(once - independent).mean()
    assert ((tree > 0.5) == y).mean() > 0.93 > 0.9 > ((independent > 0.5) == y).mean()
    assert (model["with_parent"] > 0.9).sum() == 2  # two edges join the three equal ones


def test_patterns_vote():
    texts = ["You are a fool", "you, are a", "I will find you!", "fine", "fool fool scum"]
    h, w = next((h, w) for _, h, w in toxicity.token_slices(pa.array(texts), True, toxicity.STEMS))
    none = np.zeros(0, np.uint64)
    v = toxicity.votes(h, w, [hash_words("fine"), none, none, none])
    fired = [[name for name, x in zip(toxicity.VOTERS, row) if x] for row in v]
    assert fired == [["insult", "second_person"], [], ["threat"], ["mined_words"], ["insult", "contempt", "several_words", "repetition"]]


def test_ftrl_steps_and_dot_products_are_those_of_plain_code(spark, documents):
    """The learner against a loop over numbers, and scores against sums over a dictionary."""
    rows, labels = corpus(60)
    table = spark.createDataFrame(labels, LABELS)
    model = quality.train(documents(rows), table, bits=10)
    sample = {r["place"]: r for r in bounded_sample(documents(rows), labelled(documents(rows), table, "quality", 1000), 1000).collect()}
    make = lambda text: next((f.tolist(), v.tolist()) for _, _, f, v in quality.features(pa.array([text]), 10))
    ftrl, z, s, ys = Ftrl(10), {}, {}, [sample[p]["y"] for p in sorted(sample)]
    prior = math.log(np.mean(ys) / (1 - np.mean(ys)))

    def weight(k, l1):
        if abs(z.get(k, 0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((ftrl.beta + math.sqrt(s[k])) / ftrl.alpha + ftrl.l2)

    for _ in range(ftrl.epochs):
        for p in sorted(sample):
            f, x = make(sample[p]["text"])
            f, x, l1 = [*f, "bias"], [*np.float32(x).astype(float), 1.0], [*[ftrl.l1] * len(f), 0.0]
            w = [weight(k, one) for k, one in zip(f, l1)]
            g = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(w, x)) + prior))) - sample[p]["y"]
            for k, wk, xk in zip(f, w, x):
                old = s.get(k, 0.0)
                s[k] = old + (g * xk) ** 2
                z[k] = z.get(k, 0.0) + g * xk - (math.sqrt(s[k]) - math.sqrt(old)) / ftrl.alpha * wk
    plain = {k: weight(k, ftrl.l1) for k in z if k != "bias"}
    plain["bias"] = weight("bias", 0.0) + prior
    assert np.allclose([plain.get(k, 0.0) for k in model["feature"].tolist()], model["weight"][:-1], atol=1e-5)
    assert abs(plain["bias"] - model["weight"][-1]) < 1e-5
    for r in quality.score(documents(rows), model, 10).collect():
        f, x = make(dict(rows)[r["doc_id"]])
        assert abs(r["score"] - 1 / (1 + math.exp(-sum(plain.get(k, 0.0) * v for k, v in zip(f, x)) - plain["bias"]))) < 1e-4


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    table = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0)], LABELS)
    ids = labelled(spark.range(9).withColumnRenamed("id", "doc_id"), table, "quality", 100)
    many = spark.range(50_000).selectExpr("1L AS doc_id", "concat('text ', id % 40000) AS text")
    assert bounded_sample(many, ids, 100).count() == 100
    again = bounded_sample(many.repartition(13), ids, 100)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in bounded_sample(many, ids, 100).collect()}
    same = spark.range(50_000).selectExpr("1L AS doc_id", "'one text' AS text")
    assert bounded_sample(same, ids, 100).count() == 1
    long = spark.createDataFrame([(i, "word " * 100_000 + str(k)) for i in (1, 3, 4) for k in range(4)] + [(3, None), (4, "x" * 3_000_000)], "doc_id long, text string")
    got = [len(r["text"] or "") for r in bounded_sample(long, ids, 100, most_bytes=2_100_000).collect()]
    assert 4 <= len(got) <= 5 and sum(got) <= 2_100_000


def test_the_sample_is_of_documents_that_are_there(spark, documents):
    """With a hundred labels for each document, samples are as large as their bounds let them be."""
    labels = spark.range(100_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 3 = 0 AS INT) AS toxic")
    docs = documents([(i * 97, f"some text of document {i}") for i in range(1_000)])
    free = docs.where(~held_out(F.col("doc_id"))).count()
    assert free > 600
    assert bounded_sample(docs, labelled(docs, labels, "quality", 500), 500).count() == 500
    assert bounded_sample(docs, labelled(docs, labels, "toxic", 5_000), 5_000).count() == free
    assert mixing.sample(docs, labels, mixing.DOMAINS, 500).count() == 500


def test_mixing_meets_targets(spark, documents):
    rows, labels = corpus(400)
    table = spark.createDataFrame(labels, LABELS)
    got = mixing.mix(documents(rows), table).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    tokens = {i: len(t.split()) for i, t in rows}
    assert all(r["tokens"] == tokens[r["doc_id"]] for r in got)
    p, t, rate = np.array([r["p"] for r in got]), np.array([r["tokens"] for r in got]), np.array([r["rate"] for r in got])
    total, weights = (rate * t) @ p, np.array(list(mixing.TARGETS.values()))
    have = t @ p
    target = (have / weights).min() * weights
    assert np.abs(total - target).max() < 0.01 * target.sum()
    # Plain projected gradient from the same start ends at the same rates.
    a, r = p, np.ones(len(got))
    gram = (p * t[:, None]).T @ p
    for _ in range(3000):
        r = np.maximum(0, r - a @ ((r * t) @ p - target) / gram.sum(axis=1).max())
    assert np.abs((r * t) @ p - total).max() < 0.02 * target.sum()
    capped = mixing.mix(documents(rows), table, most=1.0)
    assert max(x["rate"] for x in capped.collect()) <= 1 and max(x["copies"] for x in capped.collect()) <= 1
    domain = {i: "clean" if q and not b else "other" for i, q, b in labels}
    kept = {r["doc_id"] for r in mixing.apply(documents(rows), capped).collect()}
    clean = [i for i, d in domain.items() if d == "clean"]
    assert sum(i in kept for i in clean) > 0.95 * len(clean) and len(kept) < len(rows)


def test_posteriors_are_those_of_plain_code(spark, documents):
    rows, labels = corpus(240)
    got = {r["doc_id"]: r["p"] for r in mixing.mix(documents(rows), spark.createDataFrame(labels, LABELS)).collect()}
    place = {i: 1 if not q else 2 if b else 0 for i, q, b in labels}  # the order of mixing.DOMAINS
    sample = [(place[i], set(t.split())) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    sizes = [sum(k == d for d, _ in sample) for k in range(3)]
    held: dict = {}
    for d, words in sample:
        for w in words:
            held.setdefault(w, [0, 0, 0])[d] += 1
    vocabulary = []
    for w, n in held.items():
        if sum(n) >= mixing.MIN_SUPPORT:
            rate = [(x + 0.1) / (size + 1) for x, size in zip(n, sizes)]
            present = [math.log(r / (1 - r)) for r in rate]
            weight = [x - sum(present) / 3 for x in present]
            if (told := max(map(abs, weight))) >= mixing.LEAST_WEIGHT:
                vocabulary.append((-told * math.sqrt(sum(n)), w, weight, [math.log(1 - r) for r in rate]))
    vocabulary = {w: (weight, absent) for _, w, weight, absent in sorted(vocabulary)[: mixing.VOCABULARY]}
    base = [math.log((sizes[k] + 1) / (sum(sizes) + 3)) + sum(a[k] for _, a in vocabulary.values()) for k in range(3)]
    for i, t in rows:
        e = [math.exp(base[k] + sum(vocabulary[w][0][k] for w in set(t.split()) & vocabulary.keys()) - max(base)) for k in range(3)]
        assert np.allclose(got[i], [x / sum(e) for x in e], atol=1e-9)


def test_mixing_of_odd_rows(spark, documents):
    rows, labels = corpus(60)
    table = spark.createDataFrame(labels, LABELS)
    docs = documents(rows + ODD + [rows[0], rows[0]])
    got = mixing.mix(docs, table)
    assert got.where("tokens = 0").count() == 3 and got.count() == len(rows) + len(ODD)
    out = mixing.apply(docs, got)
    assert out.columns == docs.columns
    with pytest.warns(UserWarning, match="mixing: no tokens at all"):
        assert mixing.mix(docs.where("false"), table).count() == 0
    assert mixing.mix(docs, table.where("false")).count() == len(rows) + len(ODD)


def test_scarce_domain_does_not_limit_a_bounded_mix(spark):
    soft = spark.createDataFrame([(i, 10, [1.0, 0.0, 0.0] if i < 200 else [0.0, 1.0, 0.0] if i < 260 else [0.0, 0.0, 1.0]) for i in range(261)], "doc_id long, tokens long, p array<double>")
    rated, target = mixing.fit_rates(soft, [0.9, 0.07, 0.03], mixing.Scratch(spark), most=1.0)
    rate = {r["doc_id"]: r["rate"] for r in rated.collect()}
    assert min(rate[i] for i in range(200)) > 0.99 and rate[260] > 0.99 and max(rate[i] for i in range(200, 260)) < 0.3
    assert target[0] == 2000 and target[2] == 10


def test_rates_go_on_until_nothing_is_left_to_gain(spark, recwarn):
    rng = np.random.default_rng(3)
    p, tokens, weights = rng.dirichlet([0.3] * 3, 2000), rng.integers(1, 400, 2000), [0.9, 0.07, 0.03]
    soft = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    rated, target = mixing.fit_rates(soft, weights, mixing.Scratch(spark))
    rate = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    gap = np.abs((rate * tokens) @ p - target).max() / sum(target)
    assert gap < mixing.TOLERANCE and not [w for w in recwarn if "mixing" in str(w.message)]
    even = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="mixing: totals miss their targets"):
        mixing.fit_rates(even, [0.9, 0.1], mixing.Scratch(spark))
