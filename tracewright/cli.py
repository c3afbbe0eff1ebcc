"""The command line: analyze, benchmark, the pattern tools, and the call tracer converter.

Exit codes: 1 for usage errors and failed checks, 2 for errors of patterns, traces or runs,
3 if the output cannot be written.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from . import __version__
from .operators.taxonomy import DEFAULT, Registry
from .plans.check import validate
from .plans.compiler import Pattern, compile_node, compile_pattern
from .plans.diagnostics import PatternError, has_errors
from .plans.layout import format_pattern
from .plans.syntax import parse
from .sources.library import SHIPPED, SUFFIX, UsageError, load_patterns, pattern_files

FORMATS = ("human", "json", "markdown", "csv")


class ChecksFailed(Exception):
    """Some check didn't pass; the text says which."""


def _session():
    from .session import local_session

    return local_session("tracewright")


def run_analyze(args) -> str:
    from . import analysis

    fmt = args.format or "human"
    if fmt == "csv":
        raise UsageError("analyze has no csv output; benchmark has")
    spark = _session()
    text = Path(args.trace)
    if not text.is_file():
        raise UsageError(f"{text} is not a file")
    checked = analysis.analyze(spark, text, [])  # a bad trace is reported before a bad pattern
    patterns = load_patterns(args.patterns)
    report = analysis.analyze(spark, text, patterns) if patterns else checked
    return {"human": analysis.to_human, "json": analysis.to_json, "markdown": analysis.to_markdown}[fmt](report)


def run_benchmark(args) -> str:
    from . import harness

    suite = Path(args.suite)
    if not suite.exists():
        raise UsageError(f"{suite} does not exist")
    report = harness.run_suite(_session(), suite.stem if suite.is_file() else suite.name, harness.load_suite(suite))
    return {"human": harness.to_human, "json": harness.to_json, "markdown": harness.to_markdown, "csv": harness.to_csv}[args.format or "human"](report)


# ------------------------------------------------------------------ pattern tools


def template(name: str, family: str) -> str:
    return format_pattern(
        f"pattern {name} version 1 {{ family: {family} severity: Medium tags: [] references: [] "
        "evidence { required suspicious_call: call(kind: External, succeeded: true) } constraint: suspicious_call }"
    )


def trace_template(succeeded: bool) -> str:
    a, b = "0x" + "11" * 20, "0x" + "22" * 20
    return json.dumps(
        {
            "transaction": {"hash": "0x" + "00" * 32, "from": a, "to": b, "value": "0x0", "nonce": "0x0", "gasUsed": "0x5208", "status": "success" if succeeded else "reverted"},
            "block": {"number": "0x1", "timestamp": "0x1", "chainId": "0x1"},
            "root": {"kind": "call", "from": a, "to": b, "value": "0x0", "gasLimit": "0x5208", "gasUsed": "0x5208", "succeeded": succeeded},
        },
        indent=2,
    ) + "\n"


def run_new_pattern(args) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", args.name):
        raise UsageError(f"`{args.name}` is not a valid pattern name: ASCII letters, digits and underscores, not starting with a digit")
    root, family = Path(args.dir), args.family or "".join(w.capitalize() for w in args.name.split("_"))
    files = {
        root / "patterns" / f"{args.name}{SUFFIX}": template(args.name, family),
        root / "demo" / f"{args.name}_positive.json": trace_template(True),
        root / "demo" / f"{args.name}_negative.json": trace_template(False),
        root / "docs" / "patterns" / f"{args.name}.md": f"# {args.name}\n\nFamily: {family}\n\nWhat the pattern finds, and what it does not.\n",
        root / "docs" / "taxonomy-todo" / f"{args.name}.md": f"# Taxonomy of {family}\n\nName the registry entries of this family, then register them.\n",
    }
    if not args.force and (there := [p for p in files if p.exists()]):
        raise UsageError(f"{there[0]} already exists; --force overwrites it")
    for path, text in files.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return f"Scaffolded pattern `{args.name}`:\n" + "".join(f"  {p}\n" for p in files)


def check_trace(pattern: Pattern, path: Path) -> int:
    """The number of grounded findings of a pattern in a trace file."""
    from .analysis import analyze

    return sum(f["status"] == "grounded" for f in analyze(_session(), path, [pattern])["findings"])


def run_validate_pattern(args, taxonomy: Registry = DEFAULT) -> str:
    path = Path(args.pattern)
    if not path.is_file():
        raise UsageError(f"{path} is not a file")
    source = path.read_text(encoding="utf-8")
    lines: list[str] = []

    def note(ok: bool, what: str, detail: str = "") -> bool:
        lines.append(f"[{'ok' if ok else 'FAIL'}] {what}" + (f": {detail}" if detail else ""))
        return ok

    def verdict() -> str:
        text = "\n".join(lines) + "\n"
        if any(line.startswith("[FAIL]") for line in lines):
            raise ChecksFailed(text)
        return text

    node, problems = parse(source)
    if not note(node is not None and not has_errors(problems), "syntax", "; ".join(d.render(source) for d in problems)):
        return verdict()
    problems = validate(node)
    if not note(not has_errors(problems), "metadata and evidence", "; ".join(d.render(source) for d in problems)):
        return verdict()
    try:
        pattern = compile_node(node, source)
        note(True, "compilation")
    except (PatternError, ValueError) as e:
        note(False, "compilation", str(e))
        return verdict()
    codes = [e["code"] for e in taxonomy.map_family(pattern.family)]
    note(bool(codes), "taxonomy", ", ".join(codes) or f"family {pattern.family} has no entry")
    demo = Path(args.demo) if args.demo else path.parent.parent / "demo"
    for sign, wanted in (("positive", True), ("negative", False)):
        trace = Path(getattr(args, sign) or demo / f"{path.stem}_{sign}.json")
        try:
            n = check_trace(pattern, trace)
            note((n > 0) == wanted, f"{sign} trace", f"{n} grounded finding(s)")
        except ValueError as e:
            note(False, f"{sign} trace", str(e))
    return verdict()


def run_format_pattern(args) -> str:
    path = Path(args.pattern)
    if not path.is_file():
        raise UsageError(f"{path} is not a file")
    source = path.read_text(encoding="utf-8")
    made = format_pattern(source)
    if args.check:
        if made != source:
            raise ChecksFailed(f"{path} is not in canonical layout\n")
        return f"{path} is in canonical layout\n"
    if args.write:
        path.write_text(made, encoding="utf-8")
        return f"{path} written\n"
    return made


def run_doctor(args, taxonomy: Registry = DEFAULT) -> str:
    files, issues, ids = pattern_files(args.patterns), [], {}
    for path in files:
        try:
            p = compile_pattern(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            issues.append((path, f"does not compile: {e}"))
            continue
        ids.setdefault(p.id, []).append(path)
        if not taxonomy.map_family(p.family):
            issues.append((path, f"family {p.family} has no taxonomy entry"))
        for sign in ("positive", "negative"):
            trace = Path(args.demo) / f"{path.stem}_{sign}.json"
            if not trace.is_file():
                issues.append((path, f"missing {sign} demo trace at `{trace}`"))
    issues += [(paths[-1], f"duplicate pattern id `{i}` used in more than one file") for i, paths in ids.items() if len(paths) > 1]
    text = f"Checked {len(files)} pattern file(s)\n" + "".join(f"  {p}: {what}\n" for p, what in issues)
    if issues:
        raise ChecksFailed(text + f"\n{len(issues)} issue(s) found\n")
    return text + "No issues found\n"


def run_convert(args) -> str:
    from .sources.calltracer import convert

    made = json.dumps(convert(Path(args.input).read_text(encoding="utf-8"), args.tx_hash, args.block, args.chain_id, args.nonce), indent=2) + "\n"
    return made


def run_completions(args) -> str:
    names = " ".join(sorted(COMMANDS))
    if args.shell == "bash":
        return f'complete -W "{names}" tracewright\n'
    return f"compdef '_arguments \"1: :({names})\"' tracewright\n" if args.shell == "zsh" else f"complete -c tracewright -f -a '{names}'\n"


def run_version(_args) -> str:
    return f"tracewright {__version__}\n"


COMMANDS = {
    "analyze": run_analyze, "benchmark": run_benchmark, "new-pattern": run_new_pattern, "validate-pattern": run_validate_pattern,
    "format-pattern": run_format_pattern, "doctor": run_doctor, "convert-calltracer": run_convert, "completions": run_completions, "version": run_version,
}


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--output", metavar="FILE", help="write there instead of standard output")
    shared.add_argument("--format", choices=FORMATS)
    shared.add_argument("--quiet", action="store_true")
    shared.add_argument("--verbose", action="store_true")
    top = argparse.ArgumentParser(prog="tracewright", description=__doc__.split("\n")[0])
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name: sub.add_parser(name, parents=[shared])
    p = add("analyze")
    p.add_argument("trace")
    p.add_argument("--patterns", default=str(SHIPPED))
    p = add("benchmark")
    p.add_argument("suite")
    p = add("new-pattern")
    p.add_argument("name")
    p.add_argument("--family")
    p.add_argument("--dir", default=".")
    p.add_argument("--force", action="store_true")
    p = add("validate-pattern")
    p.add_argument("pattern")
    for option in ("--positive", "--negative", "--demo"):
        p.add_argument(option)
    p = add("format-pattern")
    p.add_argument("pattern")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--write", action="store_true")
    how.add_argument("--check", action="store_true")
    p = add("doctor")
    p.add_argument("--patterns", default=str(SHIPPED))
    p.add_argument("--demo", default="demo")
    p = add("convert-calltracer")
    for option in ("--input", "--tx-hash", "--block", "--chain-id"):
        p.add_argument(option, required=True)
    p.add_argument("--nonce", default="0x0")
    p = add("completions")
    p.add_argument("shell", choices=("bash", "zsh", "fish"))
    add("version")
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    code = 0
    try:
        text = COMMANDS[args.command](args)
    except ChecksFailed as e:
        text, code = str(e), 1
    except (UsageError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:
        if args.verbose:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args.output:
        try:
            Path(args.output).write_text(text, encoding="utf-8")
        except OSError as e:
            print(f"error: cannot write {args.output}: {e}", file=sys.stderr)
            return 3
    elif not args.quiet:
        sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
