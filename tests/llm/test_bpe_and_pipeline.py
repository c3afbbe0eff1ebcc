import hashlib
import random

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tracewright.llm import byte_bpe, line_dedup, mixing, ngram_join, toxicity
from tracewright.llm.queries import ORACLE_SQL, QUERIES

from .conftest import prose
from .test_formatting_and_lines import plain_dedup
from .test_learning import LABELS, ODD, corpus
from .test_similarity import shingles

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


LIBRARY = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def reference(text):
    return LIBRARY.encode_ordinary(text or "")


def plain_merge(piece, ranks):
    """Every pair is looked at before each merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_plain_code():
    rng, ranks = random.Random(3), byte_bpe.load_ranks(PATH)
    pieces = ["".join(rng.choice("aehinorté🙂 ") for _ in range(rng.randint(1, n))) for n in (40, 400) for _ in range(200)] + ["é漢🙂", "\x00a", "aaaaaaa"]
    assert all(byte_bpe.merge(p, PATH) == ([ranks[p.encode()]] if p.encode() in ranks else plain_merge(p.encode(), ranks)) for p in pieces)


def test_ordinary_documents_cross_seams():
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    cut = [list(byte_bpe.windows_of(len(t), byte_bpe.WINDOW, byte_bpe.OVERLAP)) for (t,) in texts]
    assert sum(len(c) > 1 for c in cut) > 0.8 * len(texts)
    stitched = [byte_bpe.stitch([byte_bpe.encode_window(t[a:b], a, last, byte_bpe.OVERLAP, PATH, P.PATTERN) for a, b, last in c]) for (t,), c in zip(texts[:200], cut)]
    met = [i for i, ids in enumerate(stitched) if ids is not None]
    assert len(met) > 0.95 * 200 and all(stitched[i] == np.array(reference(texts[i][0]), "<u4").tobytes() for i in met)


def test_encoding_equals_the_library(documents):
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choice("ab  \n\n\t'sé漢🙂12.,!") for _ in range(n))
    rows = [(i, junk(rng.randint(0, 300))) for i in range(60)] + [(100 + i, prose(rng, 200)) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "a" * 5_000), (203, " " * 3_000), (204, "x y " * 2_000), (None, "no id"), (None, "no id, and long " * 40), (1, rows[1][1]), (205, junk(4_000)), (205, junk(4_000)), (206, rows[-1][1]), (206, rows[-1][1])]
    wanted = sorted((str(i), hashlib.sha256(np.array(reference(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for window, overlap, spread in ((512, 64, 1 << 18), (100, 24, 150), (40, 12, 0)):
        got = byte_bpe.digests(byte_bpe.encode(documents(rows), PATH, P.PATTERN, window, overlap, spread), PATH).collect()
        assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in got) == wanted, window
    assert byte_bpe.encode(documents(rows).where("false"), PATH, P.PATTERN).count() == 0


def test_boundaries_resynchronise():
    text = prose(random.Random(1), 400)
    whole = set(byte_bpe.boundaries(text, P.PATTERN))
    for at in range(1, 60):
        ends = [e + at for e in byte_bpe.boundaries(text[at:], P.PATTERN)]
        first = next(e for e in ends if e in whole)
        assert first - at < 20 and {e for e in ends if e >= first} <= whole


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus(500)
    rng = random.Random(8)
    shared = "This license line stands in very many of the documents."
    rows = [(i, f"{t}\n{shared}" if i % 3 == 0 else t) for i, t in rows]
    near = prose(rng, 120)
    rows += [(1000 + k, near + f" end{k}") for k in range(6)] + [(1100 + k, near) for k in range(2)] + ODD + [(None, "a few plain words, without an id")]
    root = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_against_plain_code(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, tables).write.parquet(out := str(tmp_path / str(k)))
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            score = toxicity.scorer(toxicity.train(before, labels))
            import pyarrow as pa

            keep = [x for x in pairs(before) if score(pa.array([x[1]], pa.string()))[0] < toxicity.THRESHOLD]
            assert pairs(docs) == keep and len(keep) < before.count()
        elif name == "line dedup":
            assert pairs(docs) == sorted(((i, t) for i, _, _, t in plain_dedup(pairs(before))), key=repr)
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "n-gram Jaccard join":
            sets = {x: shingles(x[1], 5) for x in pairs(before)}
            kept = {i for i, _ in pairs(docs)}
            group = [i for i in range(1000, 1102) if any(d == i for d, _ in sets)]
            assert len(kept & set(group)) == 1 and None in {i for i, _ in pairs(before)} and None in kept
            for x in sets:
                if x[0] not in kept:
                    assert any(y[0] is not None and y[0] < x[0] for y in sets if y != x and sets[x] and 10 * len(sets[x] & sets[y]) >= 7 * len(sets[x] | sets[y]))
        elif name == "mixing":
            copies = {(r["doc_id"], r["text"]): r["copies"] for r in before.join(mixing.mix(before, labels, most=1.0).select("doc_id", "copies"), "doc_id").collect()}
            named = [x for x in pairs(docs) if x[0] is not None]
            assert named == sorted((x for x, n in copies.items() if n for _ in range(n)), key=repr)
        else:
            wanted = sorted(hashlib.sha256(np.array(reference(t), "<u4").tobytes()).hexdigest() for _, t in pairs(before))
            assert sorted(r["ids_sha256"] for r in docs.collect()) == wanted


def test_stages_take_odd_rows_extra_columns_and_empty_tables(spark, tables, documents):
    rows, _ = corpus(40)
    docs = documents(rows + ODD + [rows[0], rows[0]])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        assert out.count() > 0 and stage(spark, docs.where("false"), tables).count() == 0


def test_run_is_the_stages_in_order(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    assert set(corpus_pipeline.run(spark, tables).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_keeps_clean_documents(spark, tables):
    clean = {i for i, good, bad in corpus(500)[1] if good and not bad}
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, tables).select("doc_id").collect()}
    assert len(clean & kept) > 0.95 * len(clean), (len(clean & kept), len(clean))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert ngram_join.NGRAM == 3 and line_dedup.MIN_DOCS == 3 and byte_bpe.WINDOW > byte_bpe.OVERLAP
