"""From trace documents and patterns to findings: for many traces as a DataFrame, for one as a report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


from .operators.ground import match_and_ground
from .operators.metrics import trace_summary
from .operators.taxonomy import DEFAULT, Registry
from .plans.compiler import Pattern
from .sources.documents import IngestionError, errors_of, in_memory, ingest, traces_of


def findings(traces: DataFrame, patterns: list[Pattern], taxonomy: Registry = DEFAULT) -> DataFrame:
    """Findings with their taxonomy for enriched trace rows; no shuffle."""
    return taxonomy.attach(match_and_ground(traces, patterns), [p.family for p in patterns])


def analyze_documents(documents: DataFrame, patterns: list[Pattern], taxonomy: Registry = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) for rows of (trace_id, doc). Both read the documents; persist them if that is dear."""
    ingested = ingest(documents)
    return findings(traces_of(ingested), patterns, taxonomy), errors_of(ingested)


def analyze(spark: SparkSession, path: str | Path, patterns: list[Pattern], taxonomy: Registry = DEFAULT) -> dict:
    """The report on one trace file. A bad trace is an IngestionError."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise IngestionError("SourceUnavailable", str(e)) from None
    ingested = ingest(in_memory(spark, {str(path): text})).persist()
    try:
        if bad := errors_of(ingested).first():
            raise IngestionError(bad["error_kind"], bad["error"])
        traces = traces_of(ingested)
        summary = trace_summary(traces).first()
        rows = findings(traces, patterns, taxonomy).orderBy("pattern_pos", "candidate_pos").collect() if patterns else []
    finally:
        ingested.unpersist()
    keep = ("pattern_id", "pattern_version", "pattern_family", "pattern_severity", "candidate_id", "status", "required_total", "required_verified", "optional_total", "optional_verified", "explanation")
    found = [
        {k: r[k] for k in keep} | {"abstain_reasons": [a["detail"] for a in r["abstain_reasons"]], "taxonomy": [t.asDict() for t in r["taxonomy"]]}
        for r in rows
    ]
    trace = {
        "trace_path": str(path), "transaction_hash": summary["tx_hash"], "block_number": str(summary["block_number"]), "chain_id": str(summary["chain_id"]),
        **{k: summary[k] for k in ("call_count", "storage_change_count", "log_count", "token_transfer_count")},
    }
    return {"trace": trace, "patterns_run": len(patterns), "candidate_count": len(found), "findings": found}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2)


def _entry(t: dict) -> str:
    return f"{t['taxonomy']} {t['code']}: {t['title']}" + (f" ({t['reference_url']})" if t["reference_url"] else "")


def to_human(report: dict) -> str:
    t, found = report["trace"], report["findings"]
    out = [
        f"Trace: {t['trace_path']}",
        f"  transaction {t['transaction_hash']} (block {t['block_number']}, chain {t['chain_id']})",
        f"  {t['call_count']} call(s), {t['storage_change_count']} storage change(s), {t['log_count']} log(s), {t['token_transfer_count']} token transfer(s)",
        "",
        f"Ran {report['patterns_run']} pattern(s), found {report['candidate_count']} candidate match(es), {len(found)} finding(s) after grounding:",
    ]
    if not found:
        out.append("  (no candidates found)")
    for f in found:
        out += ["", f"[{f['status'].upper()}] {f['pattern_id']} v{f['pattern_version']} ({f['pattern_family']}, {f['pattern_severity']})", f"  candidate: {f['candidate_id']}"]
        out.append(f"  required evidence: {f['required_verified']}/{f['required_total']} verified; optional: {f['optional_verified']}/{f['optional_total']} verified")
        out.append(f"  {f['explanation']}")
        out += ["  abstain reasons:", *(f"    - {r}" for r in f["abstain_reasons"])] if f["abstain_reasons"] else []
        out += ["  taxonomy:", *(f"    - {_entry(x)}" for x in f["taxonomy"])] if f["taxonomy"] else []
    return "\n".join(out) + "\n"


def to_markdown(report: dict) -> str:
    from .harness import _rows

    t = report["trace"]
    fields = [["Transaction", t["transaction_hash"]], ["Block", t["block_number"]], ["Chain", t["chain_id"]], ["Calls", t["call_count"]]]
    fields += [["Storage changes", t["storage_change_count"]], ["Logs", t["log_count"]], ["Token transfers", t["token_transfer_count"]]]
    counts = [["Patterns run", report["patterns_run"]], ["Candidate matches", report["candidate_count"]], ["Findings", len(report["findings"])]]
    out = [f"# Trace analysis: {t['trace_path']}", "", "## Trace", "", *_rows(["Field", "Value"], fields), "## Summary", "", *_rows(["Metric", "Value"], counts), "## Findings", ""]
    if not report["findings"]:
        out.append("No candidates found.")
    for f in report["findings"]:
        out += [f"### {f['pattern_id']} v{f['pattern_version']}: {f['status']}", "", f"- Family: {f['pattern_family']}", f"- Severity: {f['pattern_severity']}"]
        out += [f"- Candidate: `{f['candidate_id']}`", f"- Required evidence: {f['required_verified']}/{f['required_total']}", f"- {f['explanation']}"]
        out += [f"- Abstained: {r}" for r in f["abstain_reasons"]] + [f"- {_entry(x)}" for x in f["taxonomy"]] + [""]
    return "\n".join(out).rstrip("\n") + "\n"


def write(found: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings of many traces to parquet, json or orc; each task writes its own part."""
    found.write.mode("overwrite").format(fmt).save(path)



