import random
import re

import numpy as np
import pytest


from tracewright.llm import ann, embedding_dedup, ngram_join, substring_dedup
from tracewright.llm.components import components

from .conftest import prose
from .llm_plain import components as plain_components


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((50, 30), (200, 190), (30, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(7, None)]
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        wanted = plain_components([(a, b) for a, b in edges if b is not None and a != b])
        assert got == wanted
    path = [(i, i + 1) for i in range(300)]
    assert {r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(base, rng, edits):
    w = base.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, documents, n, num):
    rng = random.Random(n)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.choice([1, 2, 3, 6, 12, 40, 150, 400]))
        rows += [(len(rows) + k, near(base, rng, rng.choice([0, 0, 1, 2, 3, 6])).replace(" ", rng.choice([" ", "\n", "  "]))) for k in range(6)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "ONE two"), (None, rows[0][1]), (3, rows[3][1]), (906, "w" * 5000 + " " + prose(rng, 3000))]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update({frozenset(shingles(t, n))})
    ids = sorted(i for i in sets if i is not None)
    edges = []
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                edges.append((x, y))
    wanted = plain_components(edges)
    got = ngram_join.join_components(documents(rows), n, num, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(
        ((i, len(shingles(t, n)), None if i is None else wanted.get(i, i)) for i, t in rows), key=repr
    )
    assert len(set(wanted.values())) > 5


def test_jaccard_join_of_nothing(documents):
    assert ngram_join.join_components(documents([(1, "x")]).where("false")).count() == 0


def test_matching_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num in (90, 80):
        pe = ngram_join.PartEnum(num, 100)
        for size in (5, 9, 10, 11, 20, 57, 180, 333, 1000, 2500):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(12):
                drop, add = rng.integers(0, size // 8 + 1), rng.integers(0, size // 8 + 1)
                other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
                common = len(np.intersect1d(base, other))
                match = 100 * common >= num * (len(base) + len(other) - common)
                if match and len(base) != common:
                    assert np.intersect1d(pe.signatures(base), pe.signatures(other)).size, (num, size, drop, add)
                a, b = ngram_join.short_sketch(base), ngram_join.short_sketch(other)
                assert sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b) <= len(base) + len(other) - 2 * common


VECTORS = "vec_id long, embedding array<float>, label int, e string, rep string, codes string, block string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "x", "x", "x", 1) for i, v, label in rows], VECTORS)


def fixture(seed=0, n=40):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        c = rng.standard_normal(16)
        rows += [(len(rows) + k, (c + rng.standard_normal(16) * s).astype(np.float32), int(rng.integers(0, 2))) for k, s in enumerate([0, 0, 0.05, 0.1, 0.2])]
    rows += [(900, None, 1), (901, [0] * 16, 1), (902, [None] + [1] * 15, 1), (903, [float("nan")] + [1] * 15, 1), (904, [float("inf")] + [1] * 15, 1)]
    rows += [(905, rows[0][1], None), (906, [], 1), (907, [1, 2, 3], 1), (908, [2, 4, 6], 1), (909, [3e38] * 16, 1), (910, [1e-38] * 16, 1)]
    return rows


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())


@pytest.mark.parametrize("block", [1024, 3])
def test_near_vectors(spark, block):
    rows = fixture()
    links = {(i, j) for i, a, x in rows for j, b, y in rows if i != j and x is not None and x == y and usable(a) and usable(b) and len(a) == len(b) and cosine(a, b) >= 0.98}
    wanted = plain_components(links)
    got = embedding_dedup.near_duplicates(vectors(spark, rows), bucket=4, block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (sum(a == i for a, _ in links), wanted.get(i, i), wanted.get(i, i) == i) for i, _, _ in rows
    }
    assert embedding_dedup.near_duplicates(vectors(spark, rows).where("false")).count() == 0


def test_near_vectors_of_large_groups(spark):
    rows = [(i, [1, 1, 0, 0], 1) for i in range(300)] + [(300 + i, [1, 1 + i / 1e5, 0, 0], 1) for i in range(1, 200)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), block=16).collect()
    assert {r["n_links"] for r in got} == {len(rows) - 1} and {r["component_id"] for r in got} == {0}


def test_nearest(spark):
    rows = fixture(1, 60)
    rows += [(2000 + i, rows[0][1], 1) for i in range(12)]  # ties: the smaller ids win
    asked = [i for i, v, _ in rows if i % 10 == 0 and usable(v)]
    by_id = {i: v for i, v, _ in rows}
    wanted = []
    for q in asked:
        near = sorted((-cosine(by_id[q], v), i) for i, v, _ in rows if i != q and usable(v) and len(v) == len(by_id[q]))[:5]
        wanted += [(q, k + 1, i, round(-c, 9)) for k, (c, i) in enumerate(near)]
    df = vectors(spark, rows)
    for size in (65_536, 20):
        got = ann.nearest(df, df.where("vec_id % 10 = 0"), rows=size).collect()
        pairs = {(r["query_id"], r["vec_id"]) for r in got}
        hits = len(pairs & {(q, i) for q, _, i, _ in wanted})
        assert hits >= 0.95 * len(wanted)
        exact = {(q, r): s for q, r, _, s in wanted}
        assert all(round(r["score"], 9) <= exact[r["query_id"], r["rank"]] + 1e-9 for r in got)
    assert ann.nearest(df.where("false"), df).count() == 0
    one = df.where("vec_id IN (907, 908)")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(one, one.where("vec_id = 907")).collect()] == [(907, 908)]


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 2000).astype(np.uint8)
    a, b = np.concatenate([rng.integers(97, 123, n).astype(np.uint8) for n in (300,)] + [passage]), np.concatenate([rng.integers(97, 123, 77).astype(np.uint8), passage])

    def chunks(x):
        e = substring_dedup.cuts(x)
        s = np.concatenate([[0], e[:-1]])
        assert e[-1] == len(x) and (e > s).all()
        return {int(d): (int(i), int(j)) for d, i, j in zip(substring_dedup.digests(x, s, e), s, e)}

    x, y = chunks(a), chunks(b)
    shared = sum(j - i for d, (i, j) in x.items() if d in y)
    assert shared > 1800
    slow = [sum(int(substring_dedup._GEAR[a[t - k]]) << k for k in range(min(32, t + 1))) % (1 << 32) for t in range(100)]
    assert substring_dedup.gear(a)[:100].tolist() == slow
    assert len(substring_dedup.cuts(np.zeros(0, np.uint8))) == 0 and len(substring_dedup.cuts(np.full(5000, 97, np.uint8))) >= 1


def test_repeated_passages(spark, documents):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(3, 9))) for _ in range(n))
    rows, planted = [], {}
    for p in range(30):
        passage = text(55)
        holders = [p * 10 + k for k in range(rng.choice([2, 3]))]
        planted[p] = holders
        rows += [(i, f"{text(rng.randint(0, 40))} {passage} {text(rng.randint(0, 40))}") for i in holders]
    clean = [(1000 + i, text(120)) for i in range(30)]
    odd = [(2000, None), (2001, ""), (None, rows[0][1]), (2002, "a" * 70_000), (clean[0][0], clean[0][1])]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(documents(rows + clean + odd)).collect()}
    caught = sum(all(i in got and holders[0] in got[i]["first_doc_ids"] for i in holders[1:]) for holders in planted.values())
    assert caught >= 28
    assert not set(got) & {i for i, _ in clean} and not {h[0] for h in planted.values()} & set(got)
    spans = substring_dedup.repeated_spans(documents(rows + clean))
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(documents(rows + clean), spans).collect()}
    assert all(cut[i] == t for i, t in clean) and len(cut[planted[0][1]]) < len(dict(rows)[planted[0][1]]) - 200
    assert substring_dedup.repeated_spans(documents(rows).where("false")).count() == 0


def _random_text(rng, n, least=3, most=9):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most))) for _ in range(n))


def test_short_repeats_from_several_documents_are_no_passage(spark, documents):
    rng = random.Random(4)
    whole = _random_text(rng, 200)
    parts = [whole[i : i + 85] for i in range(0, len(whole) - 85, 15)]
    rows = [(i, f"{_random_text(rng, 30)} {part} {_random_text(rng, 30)}") for i, part in enumerate(parts[::3] + parts[1::3] + parts[2::3])]
    # Neighbours of 85 bytes overlap in 70, so no two documents share 96.
    rows.append((1000, whole))
    spans = substring_dedup.repeated_spans(documents(rows))
    assert spans.count() == 0
    assert {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(documents(rows), spans).collect()} == dict(rows)


def test_passages_are_found_to_their_edges(spark, documents):
    rng = random.Random(6)
    rows, at = [], {}
    for p in range(150):
        passage = _random_text(rng, 51, 2, 5)
        for k, edge in enumerate("\u00e9\u00e8"):  # two characters that share their first byte
            head = f"{_random_text(rng, 20)}{'xy'[k]}"
            rows.append((2 * p + k, f"{head}{passage}{edge}{_random_text(rng, 20)}"))
            at[2 * p + k] = (len(head), len(head) + len(passage))
    got = {r["doc_id"]: (r["span_starts"], r["span_ends"], r["first_doc_ids"]) for r in substring_dedup.repeated_spans(documents(rows)).collect()}
    assert set(got) <= {2 * p + 1 for p in range(150)} and len(got) >= 149
    assert all(got[i] == ([at[i][0]], [at[i][1]], [i - 1]) for i in got)


@pytest.mark.parametrize("even", [20_000, 50_000, 100_000])
def test_repeats_go_on_over_long_stretches_without_a_cut(spark, documents, even):
    rng = random.Random(even)
    passage = f"{_random_text(rng, 40)} {'=' * even} {_random_text(rng, 40)}"
    rows = [(1, f"{_random_text(rng, 30)}\n{passage}\n{_random_text(rng, 30)}"), (2, f"{_random_text(rng, 50)}\t{passage}\t{_random_text(rng, 20)}")]
    (r,) = substring_dedup.repeated_spans(documents(rows)).collect()
    assert rows[1][1].encode()[r["span_starts"][0] : r["span_ends"][-1]].decode() == passage and r["n_spans"] == 1


def test_texts_that_share_an_id_have_spans_of_their_own(spark, documents):
    rng = random.Random(12)
    passage = _random_text(rng, 60)
    rows = [(1, f"{_random_text(rng, 30)} {passage}"), (2, f"{passage} {_random_text(rng, 40)}"), (2, _random_text(rng, 200)), (2, f"{_random_text(rng, 90)} {passage}")]
    rows += [rows[1]] * 3 + [(3, passage), (3, passage)]
    spans = substring_dedup.repeated_spans(documents(rows))
    assert sorted((r["doc_id"], r["first_doc_ids"]) for r in spans.collect()) == [(2, [1]), (2, [1]), (3, [1])]
    kept = sorted((r["doc_id"], r["text"].strip()) for r in substring_dedup.remove_spans(documents(rows), spans).collect())
    assert kept == sorted((i, t if i == 1 else t.replace(passage, "").strip()) for i, t in rows)


def test_spans_against_plain_code(spark, documents):
    """Random texts of pieces: each span's bytes stand in a document that keeps them, and each long passage that two documents share is found."""
    rng = random.Random(13)
    shared = [_random_text(rng, rng.randint(8, 70)) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.3 else _random_text(rng, rng.randint(1, 20)) for _ in range(rng.randint(1, 8)))) for i in range(120)]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(documents(rows)).collect()}
    texts = {i: t.encode() for i, t in rows}
    for i, r in got.items():
        assert all(f < i for f in r["first_doc_ids"])
        for a, b in zip(r["span_starts"], r["span_ends"]):
            # Every stretch of MIN_SPAN bytes of a span stands in one of the documents, but for the places where two passages meet.
            inside = [any(texts[i][x : x + 48] in texts[f] for f in r["first_doc_ids"]) for x in range(a, max(a + 1, b - 48), 16)]
            assert b - a >= substring_dedup.MIN_SPAN and sum(inside) > 0.8 * len(inside)
    missed = total = 0
    for p in shared:
        p = p.encode()
        holders = sorted(i for i, t in texts.items() if p in t)
        if len(p) < 300:
            continue
        for i in holders[1:]:
            total += 1
            at, cover = texts[i].find(p), 0
            for a, b in zip(got[i]["span_starts"], got[i]["span_ends"]) if i in got else ():
                cover += max(0, min(b, at + len(p)) - max(a, at))
            missed += cover < len(p)
    assert total > 50 and missed <= 0.02 * total
