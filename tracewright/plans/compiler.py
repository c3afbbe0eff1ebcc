"""Checked patterns in the form that query planning works on. It can be written as JSON and read back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

from .check import validate
from .diagnostics import Diagnostic, PatternError, has_errors
from .schema import PREDICATES
from .syntax import Formula, PatternNode, parse


@dataclass(frozen=True)
class Clause:
    name: str
    required: bool
    kind: str
    attributes: dict[str, object]

    @property
    def unresolved(self) -> list[str]:
        """The attributes that no fact can confirm, in schema order."""
        return [a for a, rule in PREDICATES[self.kind].items() if not rule.resolvable and a in self.attributes]


@dataclass(frozen=True)
class Condition:
    """A boolean formula over clauses: op "ref" (of a clause), "and", "or" or "not"."""

    op: str
    clause: int = -1
    parts: tuple["Condition", ...] = ()

    def leaves(self, negated: bool = False) -> list[tuple[int, bool]]:
        """(clause, stands under an odd number of nots), from left to right."""
        if self.op == "ref":
            return [(self.clause, negated)]
        return [leaf for p in self.parts for leaf in p.leaves(negated != (self.op == "not"))]


@dataclass(frozen=True)
class Pattern:
    id: str
    version: int
    family: str
    severity: str
    tags: tuple[str, ...]
    references: tuple[str, ...]
    clauses: tuple[Clause, ...]
    constraint: Condition
    sequence: tuple[int, ...] | None = None
    within: int | None = None
    same_call: tuple[int, ...] | None = None

    def positive_leaves(self) -> list[int]:
        return [i for i, negated in self.constraint.leaves() if not negated]

    @property
    def anchor(self) -> int | None:
        """The clause that gives one candidate for each of its facts."""
        return next(iter([*(self.sequence or ()), *self.positive_leaves()]), None)

    def polarity(self, clause: int) -> str:
        """"positive", "negative" or "unreferenced"; ValueError if the constraint says both."""
        kinds = {negated for i, negated in self.constraint.leaves() if i == clause}
        if len(kinds) == 2:
            raise ValueError(f"pattern `{self.id}` requires clause `{self.clauses[clause].name}` both present and absent")
        return "unreferenced" if not kinds else "negative" if kinds.pop() else "positive"

    def check_bounds(self) -> "Pattern":
        used = [i for i, _ in self.constraint.leaves()] + list(self.sequence or ()) + list(self.same_call or ())
        if bad := [i for i in used if not 0 <= i < len(self.clauses)]:
            raise ValueError(f"pattern `{self.id}` refers to evidence {bad[0]}, which it does not declare")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Pattern":
        d = json.loads(text)

        def condition(x) -> Condition:
            return Condition(x["op"], x["clause"], tuple(map(condition, x["parts"])))

        for key in ("tags", "references", "sequence", "same_call"):
            d[key] = None if d[key] is None else tuple(d[key])
        d["clauses"] = tuple(Clause(**c) for c in d["clauses"])
        return Pattern(**{**d, "constraint": condition(d["constraint"])})


def parse_pattern(source: str) -> PatternNode:
    node, problems = parse(source)
    if node is None or has_errors(problems):
        raise PatternError(problems, source)
    return node


def validate_pattern(source: str) -> list[Diagnostic]:
    """All problems of a text, whether of syntax or of meaning."""
    node, problems = parse(source)
    return problems if node is None or has_errors(problems) else [*problems, *validate(node)]


def compile_node(node: PatternNode, source: str = "") -> Pattern:
    problems = validate(node)
    if has_errors(problems):
        raise PatternError(problems, source)
    place = {c.name.value: i for i, c in enumerate(node.clauses)}
    metadata = {k.value: v.value for k, v in node.metadata}

    def condition(f: Formula) -> Condition:
        return Condition("ref", place[f.name]) if f.op == "ref" else Condition(f.op, parts=tuple(map(condition, f.parts)))

    needed = [Condition("ref", i) for i, c in enumerate(node.clauses) if c.required]
    implied = needed[0] if len(needed) == 1 else Condition("and", parts=tuple(needed))
    steps, within, _ = node.sequence or (None, None, None)
    return Pattern(
        id=str(node.id.value),
        version=int(node.version.value),
        family=metadata["family"],
        severity=metadata["severity"],
        tags=tuple(dict.fromkeys(metadata.get("tags", ()))),
        references=tuple(dict.fromkeys(metadata.get("references", ()))),
        clauses=tuple(Clause(c.name.value, c.required, c.predicate.kind.value, {a.value: v.value for a, v in c.predicate.attributes}) for c in node.clauses),
        constraint=condition(node.constraint) if node.constraint else implied,
        sequence=tuple(place[w.value] for w in steps) if steps is not None else None,
        within=within.value if within is not None and within.value < 1 << 32 else None,
        same_call=tuple(place[w.value] for w in node.same_call[0]) if node.same_call else None,
    ).check_bounds()


def compile_pattern(source: str) -> Pattern:
    return compile_node(parse_pattern(source), source)


def load_pattern_file(path: str | Path) -> Pattern:
    return compile_pattern(Path(path).read_text(encoding="utf-8"))
