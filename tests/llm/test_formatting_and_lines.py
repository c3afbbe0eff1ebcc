import hashlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat_format, line_dedup

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_examples_hold_context_and_one_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "a[INST]"), (1, 3, "user", "q"), (1, 4, "assistant", "é~")]
    out = chat_format.format_chats(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)).orderBy("example").collect()
    assert [(r["example"], r["trainable"]) for r in out] == [(3, True), (5, True)]
    assert out[0]["formatted"] == "[INST]system[/INST]s</s>[INST]user[/INST]hi <~/s></s>[INST]assistant[/INST]a[~INST]</s>"
    assert out[1]["formatted"].startswith(out[0]["formatted"])
    spans = [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for r in out]
    assert spans == ["a[~INST]", "é~"]


def test_escape_is_reversible(spark):
    texts = ["</s>", "<~/s>", "<~~/s>", "[INST] [/INST]", "<s>", "[~~/INST]", "<", "[", "~", "s>", "<</s>", "[[INST]]", "", "a\nb", "🙂</s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert [r["u"] for r in got] == texts
    for r in got:
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_edge_rows(spark):
    rows = [
        (None, 0, "user", "q"), (None, 1, "assistant", "r"),  # no id: a conversation like another
        (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, "x"),  # repeated rows, null text and role, no reply
        (3, None, "assistant", ""), (3, 5, "assistant", "z" * 100_000),
        (4, 1, "assistant", "b"), (4, 1, "assistant", "a"),  # a tie: by role, then text
    ]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_back(chat_format.format_chats(df))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {None: (2, 1), 2: (3, 0), 3: (2, 100_000), 4: (2, 2)}
    assert got[2]["turns_sha256"] == sha("\nx\nuser\n\nuser\n\n") or got[2]["turns_sha256"] == sha("user\n\nuser\n\n\nx\n")
    assert got[4]["loss_sha256"] == sha("ab") and got[2]["loss_sha256"] == sha("")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def plain_dedup(rows, min_chars=20, min_docs=3):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in k)

    held: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        low = lambda x: float("-inf") if x is None else x
        keep = [x for x in lines if len(held.get(key(x), ())) < min_docs or low(i) >= max(map(low, held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines_against_plain_code(spark, documents, rng):
    common = [f"This line is shared by many documents, number {i} É" for i in range(6)]
    rows = [(i, "\n".join(rng.choice([*common, common[0].upper().replace("É", "É"), f" {common[1]}\t", "short", f"own line of document {i} {rng.random()}"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, f"{common[0]}\r\n{common[0]}"), (None, common[1]), (None, common[1]), (5, rows[5][1]), (5, common[2])]
    rows += [(200, "\n".join([common[3]] * 20_000 + ["tail"]))]
    for batches, runs in ((1, None), (4, None), (7, None)):
        got = line_dedup.dedup_lines(documents(rows), batches=batches, keep=("lang",))
        assert "lang" in got.columns
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == plain_dedup(rows)


def test_lines_of_nothing(documents):
    empty = documents([(1, "x")]).where("false")
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2, buckets=2)
    keys = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, h1 long, h2 long")
    runs.add(keys((9, 1, 1), (8, 1, 1), (9, 2, 2)))
    runs.add(keys((7, 1, 1), (7, 2, 2), (7, 3, 3)))
    sizes = [spark.table(n).count() for n, _ in runs.runs]
    assert sizes == [2, 2]  # key 1 was settled, so the second run does not hold it
    for d in (6, 5, 4):
        runs.add(keys((d, 3, 3)))
    assert len(runs.levels) >= 2
    assert sorted((r["h1"], r["max_doc"]) for r in runs.compact().collect()) == [(1, 9), (2, 9), (3, 7)]
    runs.drop()
    assert not left_over(spark)


def left_over(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_no_run_is_left_where_a_batch_fails(spark, documents, monkeypatch):
    added = line_dedup.LineRuns.add

    def add(runs, keys):
        if runs.runs:
            raise RuntimeError("lost")
        added(runs, keys)

    monkeypatch.setattr(line_dedup.LineRuns, "add", add)
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(documents([(i, f"a line that is long enough, {i % 2}") for i in range(20)]))
    assert not left_over(spark)


@pytest.mark.parametrize("heavy", [line_dedup.HEAVY, 0])
def test_heavy_lines_are_dropped_alike_and_no_table_is_left(spark, documents, monkeypatch, heavy):
    """With and without the broadcast of the heaviest keys."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    common = "this very common line stands in all of the documents"
    rows = [(i, f"line number {i} of its own\n{common}\nsecond line shared by some, {i % 7}") for i in range(60)] + [(None, common), (3, common), (99, None)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(documents(rows)).collect()), key=repr)
    assert got == plain_dedup(rows)
    assert not left_over(spark)
