"""Suites of cases with expected outcomes: loading, running all cases in one job, exports."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path
from time import perf_counter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import metrics
from .operators.ground import ground, match_and_ground
from .operators.match import find_candidates
from .operators.taxonomy import DEFAULT, Registry
from .plans.compiler import Pattern, compile_pattern
from .sources.documents import errors_of, in_memory, ingest, traces_of


class CaseError(ValueError):
    pass


@dataclass
class Case:
    id: str
    description: str
    document: str
    patterns: list[Pattern]
    expected: dict[str, str] = field(default_factory=dict)
    provenance: str = ""


def load_case(path: str | Path) -> Case:
    """A case file; paths in it are relative to it."""
    path = Path(path)
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
        patterns = []
        for p in raw["patterns"]:
            if ("source" in p) == ("file" in p):
                raise CaseError(f"{path}: a pattern needs either `source` or `file`")
            patterns.append(compile_pattern(p["source"] if "source" in p else (path.parent / p["file"]).read_text(encoding="utf-8")))
        expected = {e["pattern_id"]: e["outcome"] for e in raw.get("expected", ())}
        if bad := set(expected.values()) - set(metrics.OUTCOMES):
            raise CaseError(f"{path}: unknown outcome {min(bad)}")
        text = (path.parent / raw["trace_file"]).read_text(encoding="utf-8")
        return Case(raw["id"], raw["description"], text, patterns, expected, raw.get("provenance_label") or f"fixture:{raw['id']}")
    except (KeyError, OSError, json.JSONDecodeError) as e:
        raise CaseError(f"{path}: {e!r}") from None


def load_suite(folder: str | Path) -> list[Case]:
    """The folder's .json files by name; folders inside are not searched."""
    folder = Path(folder)
    return [load_case(p) for p in sorted(folder.iterdir()) if p.suffix == ".json" and p.is_file()] if folder.is_dir() else [load_case(folder)]


@dataclass
class Result:
    case_id: str
    pattern_id: str
    pattern_version: int
    candidates: int
    expected: str | None
    actual: str
    family: str | None = None
    statuses: list[str] = field(default_factory=list)

    @property
    def matches(self) -> bool | None:
        return None if self.expected is None else self.expected == self.actual


@dataclass
class CaseResult:
    case: Case
    results: list[Result]
    error: str | None = None

    @property
    def passed(self) -> bool:
        return self.error is None and all(r.matches is not False for r in self.results)


@dataclass
class Report:
    suite: str
    cases: list[CaseResult]
    timings: dict[str, float]  # milliseconds by stage, for the whole suite: its cases run together. Grounding takes candidates afresh; taxonomy has the metrics too
    overall: dict[str, float]
    confusion: dict[tuple[str, str], int]
    per_pattern: list[dict]
    per_family: list[dict]
    failures: list[dict]

    @property
    def passed(self) -> int:
        return sum(c.passed for c in self.cases)

    @property
    def errored(self) -> int:
        return sum(c.error is not None for c in self.cases)


def run_suite(spark: SparkSession, name: str, cases: list[Case], taxonomy: Registry = DEFAULT) -> Report:
    """All cases in one job: every distinct pattern meets every trace that some case pairs it with."""
    if twice := [i for i, n in Counter(c.id for c in cases).items() if n > 1]:
        raise CaseError(f"duplicate case id {twice[0]}")
    timings, at = {}, perf_counter()

    def lap(stage: str) -> None:
        nonlocal at
        timings[stage], at = (perf_counter() - at) * 1000, perf_counter()

    ingested = ingest(in_memory(spark, {c.id: c.document for c in cases})).persist()
    errors = {r["trace_id"]: f"{r['error_kind']}: {r['error']}" for r in errors_of(ingested).collect()}
    lap("ingestion")
    usable: dict[tuple[str, int], Pattern] = {}
    rejected: dict[str, str] = {}
    for c in cases:
        for p in c.patterns:
            try:
                for i in range(len(p.clauses)):
                    p.polarity(i)
                key = p.to_json()
                usable.setdefault((key, 0), p)
            except ValueError as e:
                rejected[p.to_json()] = str(e)
    patterns = list(usable.values())
    place = {p.to_json(): i for i, p in enumerate(patterns)}
    found: dict[tuple[str, int], list] = {}
    if patterns:
        pairs = [(c.id, place[p.to_json()]) for c in cases for p in c.patterns if p.to_json() in place]
        wanted = spark.createDataFrame(pairs, "trace_id string, pattern_pos int").distinct()
        traces = traces_of(ingested)
        candidates = find_candidates(traces, patterns).join(wanted, ["trace_id", "pattern_pos"], "left_semi").persist()
        candidates.count()
        lap("matching")
        if len({(p.id, p.version) for p in patterns}) == len(patterns):
            findings = ground(traces, patterns, candidates, strict=False)  # of the candidates at hand, so its time is its own
        else:  # two patterns of one name and version: candidates don't say of which they are
            findings = match_and_ground(traces, patterns, ids=False, fields=("status",)).join(wanted, ["trace_id", "pattern_pos"], "left_semi")
        for r in findings.select("trace_id", "pattern_pos", "candidate_pos", "status", "pattern_family").orderBy("trace_id", "pattern_pos", "candidate_pos").collect():
            found.setdefault((r["trace_id"], r["pattern_pos"]), []).append(r)
        candidates.unpersist()
    lap("grounding")
    ingested.unpersist()
    out = []
    for c in cases:
        results, problems = [], [errors[c.id]] if c.id in errors else []
        for p in c.patterns if not problems else ():
            if (key := p.to_json()) in rejected:
                problems.append(rejected[key])
                continue
            rows = found.get((c.id, place[key]), [])
            statuses = [r["status"] for r in rows]
            actual = min(statuses, key=metrics.OUTCOMES.index, default="no-match")
            results.append(Result(c.id, p.id, p.version, len(rows), c.expected.get(p.id), actual, rows[0]["pattern_family"] if rows else None, statuses))
        out.append(CaseResult(c, results, "; ".join(problems) or None))
    flat = [(i, r.case_id, r.pattern_id, r.family, r.candidates, r.expected, r.actual) for i, r in enumerate(r for c in out for r in c.results)]
    frame = spark.createDataFrame(flat, "seq int, case_id string, pattern_id string, family string, candidates int, expected string, actual string").coalesce(1)
    overall = metrics.scores(frame).first().asDict()
    confusion = {(r["expected"], r["actual"]): r["n"] for r in metrics.confusion(frame).collect()}
    by_pattern = [r.asDict() for r in metrics.per_pattern(frame).orderBy("first").collect()]
    by_family = [r.asDict() for r in metrics.per_family(frame).orderBy("first").collect()]
    for row in by_family:
        row["taxonomy"] = taxonomy.map_family(row["family"])
    failures = [{"case_id": c.case.id, "pattern_id": None, "detail": c.error} for c in out if c.error]
    failures += [{"case_id": r.case_id, "pattern_id": r.pattern_id, "detail": f"expected {r.expected}, got {r.actual}"} for c in out for r in c.results if r.matches is False]
    lap("taxonomy")
    return Report(name, out, timings, overall, confusion, by_pattern, by_family, failures)


# ------------------------------------------------------------------ exports

# Fixed value: the header of the CSV export.
CSV_HEADER = "case_id,description,pattern_id,pattern_version,candidate_count,expected,actual,matches_expectation,ingestion_ms,matching_ms,grounding_ms,taxonomy_ms,error"
_STAGES = ("ingestion", "matching", "grounding", "taxonomy")


def _quoted(text: object) -> str:
    text = "" if text is None else str(text).lower() if isinstance(text, bool) else str(text)
    return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n') else text


def to_csv(report: Report) -> str:
    """One row for each result. Times are the suite's, shared evenly by its cases, which run together."""
    times = [f"{report.timings.get(s, 0.0) / max(1, len(report.cases)):.3f}" for s in _STAGES]
    lines = [CSV_HEADER]
    for c in report.cases:
        rows = [[r.pattern_id, r.pattern_version, r.candidates, r.expected, r.actual, r.matches] for r in c.results] or [[None] * 6]
        lines += [",".join(map(_quoted, [c.case.id, c.case.description, *row, *times, c.error])) for row in rows]
    return "\n".join(lines) + "\n"


def to_json(report: Report) -> str:
    rates = ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")
    return json.dumps(
        {
            "suite_name": report.suite, "cases_run": len(report.cases), "cases_passed": report.passed, "cases_errored": report.errored,
            "overall": {k: report.overall[k] for k in rates}, "timings_ms": report.timings,
            "confusion_matrix": [
                {"expected": e, "actual": a, "count": report.confusion[e, a]} for e in metrics.OUTCOMES for a in metrics.OUTCOMES if (e, a) in report.confusion
            ],
            "per_pattern": [{"pattern_id": r["pattern_id"], "runs": r["runs"], "passed": r["passed"], "total_candidates": r["candidates"], "accuracy": r["accuracy"]} for r in report.per_pattern],
            "per_family": [{k: r[k] for k in ("family", "runs", "passed", "accuracy", "taxonomy")} for r in report.per_family],
            "failures": report.failures,
            "cases": [
                {
                    "case_id": c.case.id, "description": c.case.description, "provenance": c.case.provenance, "passed": c.passed, "error": c.error,
                    "patterns": [
                        {"pattern_id": r.pattern_id, "pattern_version": r.pattern_version, "candidate_count": r.candidates, "expected": r.expected, "actual": r.actual,
                         "matches_expectation": r.matches, "grounding_statuses": r.statuses}
                        for r in c.results
                    ],
                }
                for c in report.cases
            ],
        },
        indent=2,
    )


def _rows(header: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join(f"{x:.3f}" if isinstance(x, float) else str(x) for x in cells) + " |"
    return [line(header), "|" + "---|" * len(header), *map(line, rows), ""]


def to_markdown(report: Report) -> str:
    o = report.overall
    summary = [["Cases run", len(report.cases)], ["Cases passed", report.passed], ["Cases errored", report.errored], ["Precision", o["precision"]]]
    summary += [["Recall", o["recall"]], ["F1", o["f1"]], ["Accuracy", o["accuracy"]], ["Total time", f"{sum(report.timings.values()):.3f} ms"]]
    names = ["Grounded", "Abstain", "Ungrounded", "No-match"]
    # The headings of the report.
    out = [f"# Benchmark Report: {report.suite}", "", "## Summary", "", *_rows(["Metric", "Value"], summary)]
    out += ["## Stage timings", "", *_rows(["Stage", "Time (ms)"], [[k.capitalize(), v] for k, v in report.timings.items()])]
    out += ["## Confusion matrix", "", *_rows(["Expected \\ Actual", *names], [[e, *(report.confusion.get((e, a), 0) for a in metrics.OUTCOMES)] for e in metrics.OUTCOMES])]
    out += ["## Per-pattern statistics", "", *_rows(["Pattern", "Runs", "Passed", "Candidates", "Accuracy"], [[r[k] for k in ("pattern_id", "runs", "passed", "candidates", "accuracy")] for r in report.per_pattern])]
    out += ["## Per-family statistics", "", *_rows(["Family", "Runs", "Passed", "Accuracy"], [[r[k] for k in ("family", "runs", "passed", "accuracy")] for r in report.per_family])]
    out += ["## Failures", ""]
    out += _rows(["Case", "Pattern", "Detail"], [[f["case_id"], f["pattern_id"] or "(case-level)", f["detail"]] for f in report.failures]) if report.failures else ["None."]
    return "\n".join(out).rstrip("\n") + "\n"


def to_human(report: Report) -> str:
    o = report.overall
    lines = [f"Suite: {report.suite}", f"  {len(report.cases)} case(s) run, {report.passed} passed, {report.errored} errored"]
    lines += [f"  precision {o['precision']:.3f}, recall {o['recall']:.3f}, F1 {o['f1']:.3f}, accuracy {o['accuracy']:.3f}", ""]
    for c in report.cases:
        lines.append(f"[{'PASS' if c.passed else 'FAIL'}] {c.case.id}: {c.case.description}" + (f" ({c.error})" if c.error else ""))
        lines += [f"    {r.pattern_id} v{r.pattern_version}: {r.actual} ({r.candidates} candidate(s))" + (f", expected {r.expected}" if r.expected else "") for r in c.results]
    return "\n".join(lines) + "\n"
