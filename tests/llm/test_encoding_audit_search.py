"""Encoding by last tokens, the audit of filter orders and the ranked search, each against the library or plain code."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import filter_audit, lexical_search, word_bpe

from .conftest import prose

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids(text, size=word_bpe.SLICE):
    return np.frombuffer(word_bpe.encode_text(text, PATH, size), "<u4").tolist()


# ------------------------------------------------------------------ op11


def test_ids_are_the_librarys_on_junk():
    rng = random.Random(1)
    letters = "aabcdehinorstlu'éÉ漢字🙂ΣσςİıſßŸǅᲉ<|>/w  \n\t\x1c\x85 　.,12²½́ḃ가ㅎ𝒜"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.2:
            text = text[:7] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "</w>"]) + text[7:]
        assert ids(text) == library_ids(text) == ids(text, 16), text


def test_each_prefix_has_the_last_token_of_its_own_ids():
    """The stored token of a prefix is the last of what plain merging makes of that prefix."""
    vocabulary = word_bpe.vocabulary(PATH)
    rng = random.Random(2)

    def merged(parts):
        while True:
            found = [(vocabulary.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.rank]
            if not found:
                return parts
            _, i = min(found)
            whole = next(t for t, made in vocabulary.parts.items() if made == parts[i : i + 2] or made == tuple(parts[i : i + 2]))
            parts[i : i + 2] = [whole]

    single = {w: t for t, w in ((t, vocabulary.names[t]) for t in vocabulary.names if t not in vocabulary.parts) if len(w) == 1}
    for _ in range(12):
        word = "".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 14)))
        last = vocabulary.last_tokens(word + word_bpe.END)
        for n in range(1, len(word) + 1):
            assert last[n] == merged([single[c] for c in word[:n]])[-1]


def test_neighbours_are_those_that_merging_keeps_apart():
    vocabulary, rng = word_bpe.vocabulary(PATH), random.Random(3)
    plain = [t for t in vocabulary.parts if vocabulary.names[t].isalpha() and vocabulary.names[t].isascii()]
    seen = Counter()
    for _ in range(4000):
        a, b = rng.choice(plain), rng.choice(plain)
        joined = vocabulary.names[a] + vocabulary.names[b]
        kept = vocabulary.last_tokens(joined)[-1] == b and vocabulary.last_tokens(joined)[len(vocabulary.names[a])] == a
        assert vocabulary.beside(a, b) == kept
        seen[kept] += 1
    assert min(seen.values()) > 100


def test_settled_letters_are_cut_as_the_library_does():
    cut = word_bpe.cutter(PATH)
    chosen = [c for c in map(chr, [*range(0x600), *range(0x2000, 0x2070), *range(0x3040, 0x3100), *range(0x4E00, 0x9FB0, 37), *range(0xAC00, 0xD7A4, 41)]) if cut.settled.fullmatch(c)]
    assert len(chosen) > 1500
    for c in chosen:
        text = f"a{c}b {c}! {c}́"
        wanted = [x for x, _ in LIBRARY.pre_tokenizer.pre_tokenize_str(LIBRARY.normalizer.normalize_str(text))]
        assert [x.encode().decode("latin-1").translate(word_bpe._LETTERS) for x in cut.pretokens(text)] == wanted, hex(ord(c))


def test_word_bpe_of_documents(documents):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (None, "no id"), (1, "again, one id"), (3, None)]
    rows += [(60, "antidisestablishment" * 3_000), (61, "a <|endoftext|> b<|startoftext|>"), (62, "word " * 50_000), (62, "word " * 50_000), (63, "ΌΣΟΣ ΣΑΣ"), (64, "Ⅷ ៛ ᏸ")]
    got = word_bpe.digests(word_bpe.encode(documents(rows), PATH), PATH).collect()

    def wanted(t):
        own = library_ids(t)
        return len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(own, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(((str(r[0]), *r[1:]) for r in got)) == sorted((str(i), *wanted(t)) for i, t in rows)
    assert word_bpe.encode(documents(rows).where("false"), PATH).count() == 0


# ------------------------------------------------------------------ op12


def test_exchanges_visit_each_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = []
        for i in filter_audit.exchanges(n):
            if i is not None:
                order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == math.factorial(n)


def plain_masks(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(set(t) & set("#$%&*|")),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows),
        ]
        out.append({f for f, x in zip("ABCDE", fails) if x})
    return out


def plain_audit(rows, langs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    masks, out = plain_masks(rows), {}
    for part in {x or "" for x in langs}:
        own = [(i, m) for (i, _), m, x in zip(rows, masks, langs) if (x or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in m for _, m in own) - len(gone), sum(m == {f} for _, m in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_plain_code(spark):
    rng = random.Random(5)
    marks = ["", "", "#", "a|b", "$5"]
    texts = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", f"w{rng.randrange(300)}", "é漢"]) for _ in range(rng.choice([3, 99, 100, 130, 400]))) + rng.choice(marks) for _ in range(60)]
    texts += ["", " ", "A" * 200_000, "x " * 60_000, "same words " * 80, "ÀÉ" * 50 + "ABC", "word\x0bword\x0c" * 70, "w w " * 120]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(500, None), (501, ""), (None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[1]), (4, None), (-7, texts[2])]
    langs = [rng.choice(["en", "de", "", None]) for _ in rows]
    labels = [(rng.randrange(-10, 300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1), (3, 0, 1), (3, 1, 0)]
    docs = spark.createDataFrame([(i, t, x, "m", 1, "d") for (i, t), x in zip(rows, langs)], "doc_id long, text string, lang string, mask string, n int, digest string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in filter_audit.audit(docs, table).collect()}
    assert got == plain_audit(rows, langs, labels)
    assert filter_audit.audit(docs.where("false"), table).count() == 0
    none = filter_audit.audit(docs, table.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_many_copies_of_one_text_are_told_apart_by_id(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'one text' AS text", "CAST(NULL AS STRING) AS lang")
    labels = spark.range(10).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(rows, labels).collect()}
    assert len(got) == 600 and {r["part"] for r in got.values()} == {""}
    first = got["EABCD", 1]
    assert (first["kept"], first["removed"], first["good_lost"]) == (1, 19_999, 9) and got["AEBCD", 2]["redundant"] == 19_999


# ------------------------------------------------------------------ op13


def plain_search(rows, items, top=20):
    def terms(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]

    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, size = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // size
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.fixture
def searched(spark, documents, monkeypatch):
    def run(rows, items, top=20, cells=None, block=None):
        if cells:
            monkeypatch.setattr(lexical_search, "TREE_CELLS", cells)
        if block:
            monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
        table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, score string, rank int")
        return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical_search.search(documents(rows), table, top).collect()), key=repr)

    return run


def test_search_against_plain_code(searched):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 80)) + rng.choice(["", " Zorg", " ZORG-zorg 漢字", " the the the"])) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(900, 960)] + [(None, rows[5][1]), (None, rows[7][1]), (7, rows[8][1]), (7, rows[8][1]), (800, None), (801, ""), (802, " ,;-"), (803, "zorg " * 30_000)]
    items = [(1, rows[5][1]), (2, "zorg"), (3, "the zorg the alpha"), (4, None), (5, ""), (6, "nowhere-to-be-found"), (7, " ".join(t for _, t in rows[:30])), (7, "more zorg"), (None, "ZORG, 漢字"), (8, "x" * 100)]
    wanted = plain_search(rows, items)
    assert len(wanted) == 100
    assert searched(rows, items) == wanted
    assert searched(rows, items, 3, cells=2_000) == plain_search(rows, items, 3)
    assert searched(rows, items, 20, block=40) == wanted  # several blocks of items


def test_search_of_equal_documents_takes_the_smallest_ids(searched):
    rows = [(5_000 - i, "one text for all, with a zorg") for i in range(3_000)] + [(9_000 + i, "other words") for i in range(9_000)]
    got = searched(rows, [(1, "a zorg"), (2, "text")])
    assert [r[2] for r in sorted(got, key=lambda r: r[:2])] == [*range(2001, 2021)] * 2 and len({r[3] for r in got if r[0] == 1}) == 1


def test_search_of_nothing(searched):
    assert searched([(1, "text")], []) == [] and searched([(1, None), (2, "")], [(1, "text")]) == []


def test_bounds_hold_and_few_ranges_are_opened(documents):
    """Each range's bound is at least every score below it, and a rare term opens only the ranges that hold it."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 60)) + (" zorg" if i in (100, 2_000) else "") for i in range(4_096)]
    vocabulary = np.unique(np.concatenate([lexical_search.words(*lexical_search.text_buffer(pa.array([t])), lexical_search.TERM_CLASS)[0] for t in texts]))
    rows = lexical_search.ranges(documents(list(enumerate(texts))).coalesce(1), vocabulary).toArrow().combine_chunks().to_batches()[0]
    tree = lexical_search.MaxTree(rows, len(vocabulary), len(texts), sum(len(t.split()) for t in texts))
    assert [len(x) for x in tree.levels] == [256, 16, 1]
    zorg = int(np.searchsorted(vocabulary, lexical_search.words(*lexical_search.text_buffer(pa.array(["zorg"])), lexical_search.TERM_CLASS)[0])[0])
    terms, weights = np.array([zorg, *rng.sample(range(len(vocabulary)), 5)]), np.array([9_000, 5, 4, 3, 2, 1])
    by_term = np.zeros(len(vocabulary), np.int64)
    by_term[terms] = weights
    low = tree.bounds(0, 0, 256, terms, weights)
    for leaf in range(256):
        assert tree.scores(leaf, by_term)[1].max() <= low[leaf] <= tree.bounds(1, leaf // 16, leaf // 16 + 1, terms, weights)[0] <= tree.bounds(2, 0, 1, terms, weights)[0]
    opened = []
    scores = tree.scores
    tree.scores = lambda leaf, by: opened.append(leaf) or scores(leaf, by)
    best = lexical_search.Best(2)
    tree.search(best, terms, weights, by_term)
    assert {i for _, i in best.rows()} == {100, 2_000} and len(opened) <= 4


def test_weights_and_norms_are_whole_numbers_of_any_size():
    assert lexical_search.weight(10, 3) == math.floor(1000 * math.log(22 / 7))
    lengths = np.array([0, 1, 10**8, 3 * 10**8])
    assert lexical_search.norms(lengths, 10**12, 7 * 10**13).tolist() == [75 + 25 * n * 10**12 // (7 * 10**13) for n in lengths.tolist()]
