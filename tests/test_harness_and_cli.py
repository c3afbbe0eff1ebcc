import json
import random

import pytest
from traces import CORPUS, SENDER, VICTIM, call, text

from tracewright import harness
from tracewright.cli import main
from tracewright.operators import metrics
from tracewright.sources.library import SHIPPED


def case(folder, name, doc, pattern, expected=None, **more):
    (folder / f"{name}.trace").write_text(doc)
    body = {"id": name, "description": f"case, {name}", "trace_file": f"{name}.trace", "patterns": [pattern], **more}
    if expected:
        body["expected"] = [{"pattern_id": p, "outcome": o} for p, o in expected.items()]
    (folder / f"{name}.json").write_text(json.dumps(body))


@pytest.fixture(scope="module")
def suite(tmp_path_factory):
    folder = tmp_path_factory.mktemp("suite")
    destruct = {"source": (SHIPPED / "unsafe_selfdestruct.rcdsl").read_text()}
    (folder / "p.rcdsl").write_text((SHIPPED / "oracle_manipulation.rcdsl").read_text())
    case(folder, "a_found", CORPUS["destroyed"][0], destruct, {"unsafe_selfdestruct": "grounded"})
    case(folder, "b_missed", CORPUS["checked"][0], destruct, {"unsafe_selfdestruct": "grounded"})
    case(folder, "c_abstain", CORPUS["price"][0], {"file": "p.rcdsl"}, {"oracle_manipulation": "abstain"})
    case(folder, "d_unscored", CORPUS["destroyed"][0], destruct)
    case(folder, "e_broken", "{", destruct, {"unsafe_selfdestruct": "grounded"})
    return folder


def test_suite(spark, suite):
    report = harness.run_suite(spark, "s", harness.load_suite(suite))
    assert [(c.case.id, c.passed, c.error is None) for c in report.cases] == [
        ("a_found", True, True), ("b_missed", False, True), ("c_abstain", True, True), ("d_unscored", True, True), ("e_broken", False, False),
    ]
    o = report.overall
    assert (o["tp"], o["fp"], o["fn"], o["tn"], o["total"], o["correct"]) == (1, 0, 1, 1, 3, 2) and o["precision"] == 1 and o["recall"] == 0.5
    assert [r["pattern_id"] for r in report.per_pattern] == ["unsafe_selfdestruct", "oracle_manipulation"]
    assert {r["family"]: r["runs"] for r in report.per_family} == {"UnsafeSelfdestruct": 1, "OracleManipulation": 1}
    assert [f["case_id"] for f in report.failures] == ["e_broken", "b_missed"]
    csv = harness.to_csv(report).splitlines()
    assert csv[0] == harness.CSV_HEADER and csv[1].startswith('a_found,"case, a_found",unsafe_selfdestruct,1,1,grounded,grounded,true,') and len(csv) == 6
    made = json.loads(harness.to_json(report))
    assert made["cases_passed"] == 3 and {"expected": "grounded", "actual": "no-match", "count": 1} in made["confusion_matrix"]
    text_ = harness.to_markdown(report)
    assert "| Precision | 1.000 |" in text_ and "| grounded | 1 | 0 | 0 | 1 |" in text_ and "(case-level)" in text_
    assert "3 passed, 1 errored" in harness.to_human(report)


def test_suite_errors(spark, suite, tmp_path):
    cases = harness.load_suite(suite)
    with pytest.raises(harness.CaseError, match="duplicate"):
        harness.run_suite(spark, "s", [cases[0], cases[0]])
    case(tmp_path, "x", "{}", {"source": "a", "file": "b"})
    with pytest.raises(harness.CaseError, match="either"):
        harness.load_case(tmp_path / "x.json")


def test_ratios_of_nothing(spark):
    none = spark.createDataFrame([], "seq int, case_id string, pattern_id string, family string, candidates int, expected string, actual string")
    assert [metrics.scores(none).first()[c] for c in ("precision", "recall", "f1", "accuracy", "total")] == [0, 0, 0, 0, 0]
    assert metrics.dense_confusion(none).count() == 4


def test_net_value(spark):
    rows = [(1, "a", "b", 5), (1, "b", "a", 2), (1, "a", "a", 9), (1, "a", None, 1), (2, "a", "b", 10**38)]
    calls = spark.createDataFrame([(t, f, to, f"{v:032x}") for t, f, to, v in rows], "trace_id long, from_addr string, to_addr string, value_hex string")
    got = {(r["trace_id"], r["address"]): None if r["net"] is None else int(r["net"]) for r in metrics.net_values(calls).collect()}
    assert got == {(1, "a"): -4, (1, "b"): 3, (2, "a"): None, (2, "b"): None}


def test_net_values_are_exact_to_128_signed_bits(spark):
    rng, most = random.Random(1), (1 << 128) - 1
    rows = [(1, "a", "b", 1 << 127), (2, "a", "b", (1 << 127) - 1), (3, "a", "b", (1 << 127) + 1), (4, "a", "b", 17 * 10**37), (5, "a", "b", 10**18), (5, "b", "a", 10**18 - 1)]
    rows += [(6, "a", "b", most), (6, "b", "a", most), (7, "a", "b", most), (7, "b", "a", 1 << 127), (8, "a", "b", 10**36), (8, "a", "c", 1)]
    rows += [(9 + t, rng.choice("abc"), rng.choice("abc"), rng.choice([rng.randrange(1 << rng.randint(1, 128)), 10**18, 1 << 64])) for t in range(60) for _ in range(rng.randint(1, 5))]
    calls = spark.createDataFrame([(t, f, to, f"{v:032x}") for t, f, to, v in rows], "trace_id long, from_addr string, to_addr string, value_hex string")
    got = {(r["trace_id"], r["address"]): r["net_digits"] for r in metrics.net_values(calls).collect()}
    wanted: dict = {}
    for t, f, to, v in rows:
        if v:
            wanted[t, to] = wanted.get((t, to), 0) + v
            wanted[t, f] = wanted.get((t, f), 0) - v
    assert got == {k: str(v) if -(1 << 127) <= v < 1 << 127 else None for k, v in wanted.items()}


def test_cli(spark, suite, tmp_path, capsys):
    trace = tmp_path / "t.json"
    trace.write_text(CORPUS["reentrancy"][0])
    assert main(["analyze", str(trace)]) == 0 and "[GROUNDED] classic_reentrancy" in capsys.readouterr().out
    out = tmp_path / "out.json"
    assert main(["analyze", str(trace), "--format", "json", "--output", str(out)]) == 0 and json.loads(out.read_text())["candidate_count"] == 1
    assert main(["analyze", str(trace), "--format", "csv"]) == 1
    assert main(["analyze", str(tmp_path / "none")]) == 1 and main(["nonsense"]) == 1
    assert main(["analyze", str(trace), "--output", str(tmp_path / "no" / "where")]) == 3
    (tmp_path / "bad.json").write_text("{")
    assert main(["analyze", str(tmp_path / "bad.json")]) == 2
    capsys.readouterr()
    assert main(["benchmark", str(suite), "--format", "csv"]) == 0 and capsys.readouterr().out.startswith(harness.CSV_HEADER)
    assert main(["version"]) == 0 and main(["completions", "bash"]) == 0


def test_pattern_tools(spark, tmp_path, capsys):
    assert main(["new-pattern", "my_pattern", "--family", "Reentrancy", "--dir", str(tmp_path)]) == 0
    assert main(["new-pattern", "my_pattern", "--dir", str(tmp_path)]) == 1 and main(["new-pattern", "9x", "--dir", str(tmp_path)]) == 1
    path = tmp_path / "patterns" / "my_pattern.rcdsl"
    assert main(["format-pattern", str(path), "--check"]) == 0
    assert main(["validate-pattern", str(path)]) == 0, capsys.readouterr().out
    assert main(["doctor", "--patterns", str(tmp_path / "patterns"), "--demo", str(tmp_path / "demo")]) == 0
    (tmp_path / "demo" / "my_pattern_negative.json").write_text(text(call("call", SENDER, VICTIM)))
    assert main(["validate-pattern", str(path)]) == 1
    path.write_text("// note\n" + " ".join(path.read_text().split()))
    assert main(["format-pattern", str(path), "--check"]) == 1 and main(["format-pattern", str(path), "--write"]) == 0
    assert path.read_text().startswith("// note\npattern my_pattern version 1 {\n    family: Reentrancy\n")
    (tmp_path / "patterns" / "copy.rcdsl").write_text(path.read_text().replace("Reentrancy", "Nothing"))
    capsys.readouterr()
    assert main(["doctor", "--patterns", str(tmp_path / "patterns"), "--demo", str(tmp_path / "demo")]) == 1
    said = capsys.readouterr().out
    assert "duplicate pattern id" in said and "no taxonomy entry" in said and "missing positive demo trace" in said


def test_stream_of_files(spark, tmp_path):
    from tracewright.sources.library import load_patterns
    from tracewright.streaming.documents import findings_stream, read_stream, start

    (tmp_path / "in").mkdir()
    found = findings_stream(read_stream(spark, f"file://{tmp_path}/in", 1), load_patterns())
    for name in ("destroyed", "reentrancy", "checked"):
        (tmp_path / "in" / f"{name}.json").write_text(CORPUS[name][0])
        start(found, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["pattern_id"] for r in got) == ["classic_reentrancy", "unsafe_selfdestruct"]
