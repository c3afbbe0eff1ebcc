"""The canonical layout of a pattern's text. Comments before the pattern stay."""

from __future__ import annotations

import re

from .compiler import parse_pattern
from .syntax import Formula, PredicateNode, Word

INDENT, WIDTH = "    ", 80


def _value(w: Word) -> str:
    if w.kind == "list":
        return "[" + ", ".join(_string(x) for x in w.value) + "]"
    return _string(w.value) if w.kind == "string" else str(w.value).lower() if w.kind == "bool" else str(w.value)


def _string(text: str) -> str:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = text.replace(raw, shown)
    return f'"{text}"'


def _formula(f: Formula) -> str:
    return f.name if f.op == "ref" else f"{f.op.upper()}({', '.join(map(_formula, f.parts))})"


def _predicate(node: PredicateNode) -> str:
    attributes = [f"{name.value}: {_value(value)}" for name, value in node.attributes]
    line = f"{node.kind.value}({', '.join(attributes)})"
    if not attributes or len(2 * INDENT + "required " + line) <= WIDTH:
        return line
    return f"{node.kind.value}(\n" + ",\n".join(3 * INDENT + a for a in attributes) + f"\n{2 * INDENT})"


def leading_comments(source: str) -> str:
    return re.match(r"(?:[ \t]*(?://[^\n]*)?\n)*", source)[0].strip("\n")


def format_pattern(source: str) -> str:
    p = parse_pattern(source)
    blocks = ["".join(f"{INDENT}{k.value}: {_value(v)}\n" for k, v in p.metadata)]
    clauses = "".join(f"{2 * INDENT}{'required' if c.required else 'optional'} {c.name.value}: {_predicate(c.predicate)}\n" for c in p.clauses)
    blocks.append(f"{INDENT}evidence {{\n{clauses}{INDENT}}}\n")
    if p.same_call:
        blocks.append(f"{INDENT}same_call: [{', '.join(w.value for w in p.same_call[0])}]\n")
    if p.sequence:
        window = f" within: {p.sequence[1].value}" if p.sequence[1] else ""
        blocks.append(f"{INDENT}sequence: [{', '.join(w.value for w in p.sequence[0])}]{window}\n")
    if p.constraint:
        blocks.append(f"{INDENT}constraint: {_formula(p.constraint)}\n")
    comments = leading_comments(source)
    return (comments + "\n" if comments else "") + f"pattern {p.id.value} version {p.version.value} {{\n" + "\n".join(blocks) + "}\n"
