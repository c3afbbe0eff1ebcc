"""Matching and grounding on hand-written traces, against outcomes and against plain Python."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F
from traces import CORPUS, HELPER, OTHER, SENDER, VICTIM, call, log, text, word, write

from tracewright import analysis
from tracewright.model import CALL, STORAGE, TX, array_type, columns_of, struct_type
from tracewright.operators import ground as grounding
from tracewright.operators.enrich import enrich_traces
from tracewright.operators.fingerprint import fnv1a, message
from tracewright.operators.ground import GroundingError, ground, match_and_ground
from tracewright.operators.match import find_candidates
from tracewright.operators.taxonomy import DEFAULT, Registry
from tracewright.plans.compiler import compile_pattern
from tracewright.sources.documents import in_memory, ingest, traces_of
from tracewright.sources.library import EXAMPLES, load_patterns

ZERO = word(0)


def pattern(evidence: str, rest: str = "", family: str = "Reentrancy"):
    return compile_pattern(f"pattern p version 1 {{ family: {family} severity: Low evidence {{ {evidence} }} {rest} }}")


def traces(spark, *roots, **named):
    docs = {f"t{i}": text(r) for i, r in enumerate(roots)} | {n: text(r) for n, r in named.items()}
    return traces_of(ingest(in_memory(spark, docs)))


def found(rows):
    return [(r["trace_id"], [(b["clause"], b["fact_kind"], b["fact_id"]) for b in r["bindings"]]) for r in rows.orderBy("trace_id", "pattern_pos", "candidate_pos").collect()]


def test_corpus_outcomes(spark):
    rows = match_and_ground(traces_of(ingest(in_memory(spark, {n: d for n, (d, _) in CORPUS.items()}))), load_patterns())
    got: dict = {n: {} for n in CORPUS}
    for r in rows.orderBy("pattern_pos", "candidate_pos").collect():
        got[r["trace_id"]].setdefault(r["pattern_id"], []).append(r["status"])
    assert got == {n: {p: s for p, s in wanted.items() if s} for n, (_, wanted) in CORPUS.items()}


def test_upgrade_examples(spark):
    data = "0x3659cea8" + "00" * 32
    rows = match_and_ground(
        traces(
            spark,
            by_other=call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, data=data, writes=[write(HELPER)])),
            by_sender=call("call", SENDER, VICTIM, data=data, writes=[write(VICTIM, 3)]),
        ),
        load_patterns(EXAMPLES),
    )
    assert {(r["trace_id"], r["pattern_id"], r["status"]) for r in rows.collect()} == {
        ("by_other", "unauthorized_upgrade_to", "grounded"), ("by_other", "proxy_upgrade_self_write", "grounded"),
    }


def test_known_fingerprint():
    # A published value for the reentrancy pattern with these citations.
    assert f"{fnv1a(message('classic_reentrancy', 1, [(1, 'StorageChange', 0), (0, 'Call', 2)])):016x}" == "f803b1b939c2d12a"


def test_sequence_takes_the_earliest_fact_not_before(spark):
    p = pattern("required a: call(kind: External) required b: storage(changed: true) required c: call(kind: Create)", "sequence: [a, b, c]")
    root = call(
        "call", SENDER, VICTIM, call("create", VICTIM, None),
        call("call", VICTIM, HELPER, writes=[write(HELPER, 1)]), call("create", VICTIM, None), writes=[write(VICTIM, 2)],
    )
    rows = find_candidates(traces(spark, root), [p])
    assert found(rows) == [
        ("t0", [(0, "Call", 0), (1, "StorageChange", 0), (2, "Call", 1)]),
        ("t0", [(0, "Call", 2), (1, "StorageChange", 1), (2, "Call", 3)]),
    ]


def test_transaction_facts_have_no_order(spark):
    p = pattern("required a: call(kind: Create) required t: transaction(status: Success)", "sequence: [a, t]")
    rows = match_and_ground(traces(spark, call("call", SENDER, VICTIM, call("create", VICTIM, None))), [p])
    assert [r["status"] for r in rows.collect()] == ["grounded"] and found(rows) == [("t0", [(0, "Call", 1), (1, "Call", 0)])]


def test_same_call_does_not_backtrack(spark):
    evidence = 'required n: call(kind: Create) required s: storage(changed: true) required l: log(topic0: "%s")' % word(1)
    p = pattern(evidence, "same_call: [s, l] constraint: n")
    here = dict(writes=[write(HELPER)], logs=[log(HELPER, [word(1)], "0x", 1)])
    first = call("call", VICTIM, OTHER, writes=[write(OTHER)])
    lone = call("call", SENDER, VICTIM, first, call("call", VICTIM, HELPER, **here), call("create", VICTIM, None))
    good = call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, **here), call("create", VICTIM, None))
    rows = find_candidates(traces(spark, lone=lone, good=good), [p])
    # In `lone` the first storage change fixes the call, and no log is there; a later one is not tried.
    assert found(rows) == [("good", [(0, "Call", 2), (1, "StorageChange", 0), (2, "Log", 0)])]


def test_formulas(spark):
    parts = "required c: call(kind: Create) required s: storage(changed: true) optional d: call(kind: Delegate)"
    with_both = call("call", SENDER, VICTIM, call("create", VICTIM, None), writes=[write(VICTIM)])
    only_create = call("call", SENDER, VICTIM, call("create", VICTIM, None))
    nothing = call("call", SENDER, VICTIM)
    rows = traces(spark, a_both=with_both, b_create=only_create, c_nothing=nothing)
    names = lambda rest: [t for t, _ in found(find_candidates(rows, [pattern(parts, rest)]))]
    assert names("constraint: AND(c, s)") == ["a_both"]
    assert names("constraint: OR(c, s)") == ["a_both", "b_create"]
    assert names("constraint: AND(c, NOT(s))") == ["b_create"]
    assert names("constraint: NOT(c)") == ["c_nothing"]
    assert names("constraint: NOT(OR(c, d))") == ["c_nothing"]
    assert found(find_candidates(rows, [pattern(parts, "constraint: NOT(c)")])) == [("c_nothing", [])]
    # A required clause that is only an unmatched branch of OR: a candidate, but no certainty.
    status = {r["trace_id"]: (r["status"], [a["category"] for a in r["abstain_reasons"]]) for r in match_and_ground(rows, [pattern(parts, "constraint: OR(c, s)")]).collect()}
    assert status == {"a_both": ("grounded", []), "b_create": ("abstain", ["missing-fact"])}
    # A clause wanted absent in one branch of OR, though it is there.
    there = match_and_ground(rows, [pattern(parts, "constraint: OR(c, NOT(s))")]).where("trace_id = 'a_both'").first()
    assert there["status"] == "ungrounded" and there["abstain_reasons"] == []


def test_internal_calls_and_bad_literals_match_nothing(spark):
    rows = traces(spark, call("call", SENDER, VICTIM, writes=[write(VICTIM)], data="0x12345678"))
    for evidence in ("call(kind: Internal)", 'call(kind: External, selector: "0x1234")', 'storage(changed: true, slot: "0x0")', "call(kind: External, parent_kind: External)"):
        assert find_candidates(rows, [pattern(f"required a: {evidence}")]).count() == 0


def test_thresholds_cover_128_bits(spark):
    rows = traces(spark, call("call", SENDER, VICTIM, value=(1 << 128) - 1))
    for evidence, n in (("call(kind: External, min_value: 9223372036854775807)", 1), ("value_flow(direction: Out, max: -1)", 0), ("value_flow(direction: Out, min: -5)", 1), ("value_flow(direction: Out, max: 9)", 0)):
        assert find_candidates(rows, [pattern(f"required a: {evidence}")]).count() == n


def test_given_candidates(spark):
    rows = traces(spark, call("call", SENDER, VICTIM, call("selfdestruct", VICTIM, SENDER)))
    p = pattern("required a: call(kind: SelfDestruct)")

    def given(kind: str, fact: int, pid: str = "p", version: int = 1):
        schema = "trace_id string, pattern_id string, pattern_version int, candidate_pos int, bindings array<struct<clause: int, fact_kind: string, fact_id: int>>"
        return spark.createDataFrame([("t0", pid, version, 0, [(0, kind, fact)])], schema)

    assert [r["status"] for r in ground(rows, [p], given("Call", 1)).collect()] == ["grounded"]
    assert [r["status"] for r in ground(rows, [p], given("Call", 0)).collect()] == ["ungrounded"]
    for bad in (given("Call", 2), given("Log", 0), given("Call", 1, "q"), given("Call", 1, version=2)):
        with pytest.raises(GroundingError):
            ground(rows, [p], bad)
        assert ground(rows, [p], bad, strict=False).count() == 0


def test_verifiers_can_be_replaced(spark, monkeypatch):
    rows = traces(spark, call("call", SENDER, VICTIM))
    p = pattern("required a: call(kind: External)")
    monkeypatch.setattr(grounding, "VERIFIERS", {"storage": grounding.bindings})
    assert match_and_ground(rows, [p]).first()["status"] == "abstain"
    monkeypatch.setattr(grounding, "VERIFIERS", {})
    with pytest.raises(grounding.UnsupportedVerifier):
        match_and_ground(rows, [p])


def test_contradicting_polarity_is_an_error(spark):
    with pytest.raises(ValueError, match="both present and absent"):
        match_and_ground(traces(spark, call("call", SENDER, VICTIM)), [pattern("required a: call(kind: External)", "constraint: OR(a, NOT(a))")])


def _random_tree(rng: random.Random):
    pool = [f"0x{i:040x}" for i in range(1, 5)]
    frames = [call("call", SENDER, rng.choice(pool))]
    for _ in range(rng.randint(5, 25)):
        up = rng.choice(frames)
        kind = rng.choice(["call", "call", "staticcall", "create", "selfdestruct", "delegatecall"])
        f = call(kind, up["to"] or pool[0], None if kind == "create" else rng.choice(pool), ok=rng.random() < 0.7)
        up["calls"].append(f)
        frames.append(f)
    return frames[0]


def test_random_trees_against_plain_walks(spark):
    roots = [_random_tree(random.Random(i)) for i in range(40)]
    rows = traces(spark, *roots)

    def walk(root):
        out, left = [], [(root, [])]
        while left:
            f, above = left.pop()
            out.append((len(out), f, above))
            left += [(c, [*above, f]) for c in reversed(f["calls"])]
        return out

    reentrant = {f"t{i}": [n for n, f, up in walk(r) if f["to"] and any(u["to"] == f["to"] for u in up)] for i, r in enumerate(roots)}
    got = {r["trace_id"]: [c["call_id"] for c in r["calls"] if c["reentrant"]] for r in rows.collect()}
    assert got == reentrant
    p = pattern("required a: call(kind: SelfDestruct, ancestor_kind: Delegate)")
    wanted = [(f"t{i}", n) for i, r in enumerate(roots) for n, f, up in walk(r) if f["kind"] == "selfdestruct" and any(u["kind"] == "delegatecall" for u in up)]
    assert sorted((t, b[0][2]) for t, b in found(find_candidates(rows, [p]))) == sorted(wanted)
    once, again = (match_and_ground(rows, load_patterns()).orderBy("trace_id", "pattern_pos", "candidate_pos").collect() for _ in range(2))
    assert once == again


def test_large_traces(spark):
    a, b = f"0x{1:040x}", f"0x{2:040x}"
    chain = None
    for i in range(450):
        up, to = (a, b) if i % 2 else (b, a)
        chain = call("call", up, to, *([chain] if chain else []), writes=[write(to)])
    rows = traces(spark, chain)
    assert find_candidates(rows, [pattern("required a: call(kind: External, reentrant: true) required s: storage(changed: true)", "sequence: [a, s]")]).count() == 448
    wide = call("call", SENDER, a, *(call("call", a, b, call("call", SENDER, a, writes=[write(a)])) for _ in range(200)))
    assert match_and_ground(traces(spark, wide), load_patterns()).where("pattern_id = 'classic_reentrancy'").count() == 200


def _facts_row(spark, calls, changes):
    """A trace row of calls (kind by call) and storage changes (call by change), with thousands of each."""
    kinds = spark.createDataFrame([(list(calls), list(changes))], "kinds array<string>, changes array<int>")
    call_of = {"call_id": lambda k, i: i, "parent_id": lambda k, i: F.when(i > 0, 0), "kind": lambda k, i: k, "to_addr": lambda k, i: F.lit(SENDER), "from_addr": lambda k, i: F.lit(SENDER), "succeeded": lambda k, i: F.lit(True)}
    change_of = {"id": lambda c, i: i, "call_id": lambda c, i: c, "before": lambda c, i: F.lit("0"), "after": lambda c, i: F.lit("1")}

    def made(name, source, schema, of):
        return F.transform(source, lambda x, i: F.struct(*(of[k](x, i).alias(k) if k in of else F.lit(None).alias(k) for k in columns_of(schema)))).cast(array_type(name))

    row = kinds.select(
        F.lit("t0").alias("trace_id"), F.lit(None).cast(struct_type(TX)).alias("tx"), made("calls", "kinds", CALL, call_of).alias("calls"),
        made("storage_changes", "changes", STORAGE, change_of).alias("storage_changes"),
        F.array().cast(array_type("logs")).alias("logs"), F.array().cast(array_type("token_transfers")).alias("token_transfers"),
    )
    return enrich_traces(row)


@pytest.mark.parametrize("n", [10, 300, 10_000])
def test_sequences_and_calls_against_plain_loops(spark, n):
    """Few and very many facts in one trace: a sequence binds the earliest facts not before, same_call the first of the call."""
    rng = random.Random(n)
    kinds = ["Call"] + [rng.choice(["Call", "Create", "Selfdestruct", "StaticCall"]) for _ in range(n - 1)]
    changes = sorted(rng.randrange(n) for _ in range(n))
    rows = _facts_row(spark, kinds, changes)
    evidence = "required a: call(kind: Create) required b: storage(changed: true) required c: call(kind: SelfDestruct)"
    began = time.perf_counter()
    got = [b for _, b in found(find_candidates(rows, [pattern(evidence, "sequence: [a, b, c]")]))]
    wanted = []
    for i, k in enumerate(kinds):
        s = bisect.bisect_left(changes, i) if k == "Create" else n
        gone = next((j for j in range(changes[s], n) if kinds[j] == "Selfdestruct"), None) if s < n else None
        wanted += [] if gone is None else [[(0, "Call", i), (1, "StorageChange", s), (2, "Call", gone)]]
    assert got == wanted
    got = [b for _, b in found(find_candidates(rows, [pattern(evidence.replace("c: call(kind: SelfDestruct)", "c: call(kind: External)"), "same_call: [a, b]")]))]
    first = {c: s for s, c in reversed(list(enumerate(changes)))}
    assert [b[:2] for b in got] == [[(0, "Call", i), (1, "StorageChange", first[i])] for i, k in enumerate(kinds) if k == "Create" and i in first]
    assert time.perf_counter() - began < 60


def test_report_on_one_trace(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(CORPUS["reentrancy"][0])
    report = analysis.analyze(spark, path, load_patterns())
    assert report["patterns_run"] == 8 and report["trace"]["call_count"] == 3
    finding = report["findings"][0]
    assert finding["candidate_id"] == "f803b1b939c2d12a" and [t["code"] for t in finding["taxonomy"]] == ["SCWE-046", "SWC-107"]
    human = analysis.to_human(report)
    assert "Ran 8 pattern(s), found 1 candidate match(es), 1 finding(s)" in human and "[GROUNDED] classic_reentrancy v1 (Reentrancy, Critical)" in human
    assert "f803b1b939c2d12a" in analysis.to_json(report) and "| Calls | 3 |" in analysis.to_markdown(report)


def test_taxonomy_registry(spark):
    r = Registry()
    assert r.names == ["SCWE", "SWC"] and r.unmapped("OracleManipulation") == ["SWC"] and r.map_family("Nope") == []
    r.register("ACME", lambda family: [("A-1", "title", None)])
    assert [e["code"] for e in r.map_family("Reentrancy")] == ["A-1", "SCWE-046", "SWC-107"]
    assert DEFAULT.names == ["SCWE", "SWC"]
