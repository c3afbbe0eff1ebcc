"""Candidates of a pattern, as a projection of a trace row.

The pattern's anchor (its first sequence step, else the first clause that the constraint
wants present) gives one candidate for each of its facts. Later steps take the earliest fact
that does not come before the previous step's; the constraint asks for each clause whether
any fact satisfies it; same_call wants its members' facts in one call. A pattern without an
anchor gives at most one candidate for a trace, with nothing bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Clause, Condition, Pattern
from .predicates import BINDING, bindings

CITED = "array<struct<clause: int, fact_kind: string, fact_id: int>>"


def holds(condition: Condition, has: dict[int, Column]) -> Column:
    if condition.op == "ref":
        return has[condition.clause]
    parts = [holds(p, has) for p in condition.parts]
    if condition.op == "not":
        return ~parts[0]
    return reduce(lambda a, b: a & b if condition.op == "and" else a | b, parts)


def _cite(clause: int, b: Column) -> Column:
    return F.struct(F.lit(clause).alias("clause"), b["fact_kind"].alias("fact_kind"), b["fact_id"].alias("fact_id"))


FEW = 16  # facts among which the first of an order is found by looking at each


def first_from(facts: Column, least: Column) -> Column:
    """The place of the first fact whose order is `least` or more, or none. Facts stand in order, so where there
    are more than FEW their places are halved until one is left: the cost for many candidates of a large trace
    is theirs times the logarithm of the facts. A fact of the transaction has no order and always comes first."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["low"] + at["high"], 1)
        found = F.get(facts, mid)["ord"] >= least
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(F.when(found, at["low"]).otherwise(mid + 1).alias("low"), F.when(found, mid).otherwise(at["high"]).alias("high")))

    all_places = F.struct(F.lit(0).alias("low"), F.size(facts).alias("high"))
    searched = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(facts)))), all_places, halve, lambda at: at["low"])
    seen = F.array_position(F.transform(facts, lambda b: F.coalesce(b["ord"] >= least, F.lit(True))), F.lit(True)).cast("int") - 1
    return F.when(F.size(facts) > FEW, searched).otherwise(F.when(seen >= 0, seen).otherwise(F.size(facts)))


def candidates(p: Pattern, facts: dict[int, Column]) -> Column:
    """array<CITED>: the citations of each candidate, in anchor order. facts: each clause's bindings."""
    anchor = p.anchor
    certain = {anchor, *(p.sequence or ())} - {None}
    has = {i: F.lit(True) if i in certain else F.size(f) > 0 for i, f in facts.items()}
    condition = holds(p.constraint, has)
    if anchor is None:
        one = F.array(F.array().cast(CITED))
        return F.when(condition, one).otherwise(F.array().cast(f"array<{CITED}>"))

    def field(clause: int) -> str:
        return f"c{clause}"

    bound: list[int] = [anchor]
    made = F.transform(facts[anchor], lambda a: F.struct(a.alias(field(anchor)), F.coalesce(a["ord"], F.lit(-1)).alias("upto")))

    def extend(made: Column, clause: int, pick, upto: bool) -> Column:
        """Bind another clause in each candidate; candidates for which `pick` finds nothing go."""
        known = list(bound)

        def add(c: Column) -> Column:
            b = pick(c)
            last = F.coalesce(b["ord"], c["upto"]) if upto else c["upto"]
            return F.struct(*(c[field(k)].alias(field(k)) for k in known), b.alias(field(clause)), last.alias("upto"))

        bound.append(clause)
        return F.filter(F.transform(made, add), lambda c: c[field(clause)].isNotNull())

    def next_after(step: int):
        return lambda c: F.get(facts[step], first_from(facts[step], c["upto"]))

    for step in p.sequence[1:] if p.sequence else ():
        made = extend(made, step, next_after(step), True)
    if p.same_call:
        fixed = [m for m in p.same_call if m in bound]
        free = [m for m in p.same_call if m not in bound]
        if len(fixed) > 1:
            made = F.filter(made, lambda c: reduce(lambda a, b: a & b, [c[field(fixed[0])]["call_id"] == c[field(m)]["call_id"] for m in fixed[1:]]))
        target = (lambda c: c[field(fixed[0])]["call_id"]) if fixed else (lambda c: F.get(facts[min(p.same_call)], F.lit(0))["call_id"])

        def in_call(member: int):
            def first(c: Column) -> Column:
                found = F.get(facts[member], first_from(facts[member], target(c)))
                return F.when(found["call_id"] == target(c), found)

            return first

        for m in sorted(free):
            made = extend(made, m, in_call(m), False)

    wanted = sorted({*p.positive_leaves(), anchor, *(p.sequence or ()), *(p.same_call or ())})
    cited = F.transform(
        made,
        lambda c: F.filter(
            F.array(
                *(
                    _cite(i, c[field(i)])
                    if i in bound
                    else F.when(F.size(facts[i]) > 0, _cite(i, F.get(facts[i], F.lit(0)))).otherwise(F.lit(None).cast(CITED[6:-1]))
                    for i in wanted
                )
            ),
            lambda x: x.isNotNull(),
        ),
    ).cast(f"array<{CITED}>")
    return F.when(condition, cited).otherwise(F.array().cast(f"array<{CITED}>"))


def with_facts(traces: DataFrame, patterns: list[Pattern]) -> tuple[DataFrame, list[dict[int, Column]]]:
    """Each clause evaluated once for each trace, as a column, and each pattern's columns. Clauses that
    ask the same share one, whichever pattern they belong to."""
    names: dict[str, str] = {}
    made: dict[str, Column] = {}

    def name(c: Clause) -> str:
        asked = repr((c.kind, sorted(c.attributes.items(), key=str), sorted(c.unresolved)))
        if asked not in names:
            names[asked] = f"_facts{len(names)}"
            made[names[asked]] = bindings(c)
        return names[asked]

    columns = [{i: F.col(name(c)) for i, c in enumerate(p.clauses)} for p in patterns]
    return traces.withColumns(made), columns


def find_candidates(traces: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """trace_id, pattern_pos, pattern_id, pattern_version, candidate_pos, bindings, unresolved for enriched trace rows.

    One projection, whatever the number of patterns. The rows of a trace come in the order of
    (pattern_pos, candidate_pos), in which a single-trace run finds them.
    """
    rows, facts = with_facts(traces, [p.check_bounds() for p in patterns])
    none = F.array().cast("array<struct<clause: int, attribute: string>>")

    def one(pos: int, p: Pattern) -> Column:
        flagged = [i for i, c in enumerate(p.clauses) if c.unresolved]

        def flags(cited: Column, i: int) -> Column:
            named = F.array(*(F.struct(F.lit(i).alias("clause"), F.lit(a).alias("attribute")) for a in p.clauses[i].unresolved))
            return F.when(F.exists(cited, lambda b: b["clause"] == i), named).otherwise(none)

        return F.transform(
            candidates(p, facts[pos]),
            lambda cited, i: F.struct(
                F.lit(pos).alias("pattern_pos"), F.lit(p.id).alias("pattern_id"), F.lit(p.version).alias("pattern_version"),
                i.alias("candidate_pos"), cited.alias("bindings"), F.concat(none, *(flags(cited, k) for k in flagged)).alias("unresolved"),
            ),
        )

    found = rows.withColumns({f"_found{i}": one(i, p) for i, p in enumerate(patterns)})
    return found.select("trace_id", F.inline(F.concat(*(f"_found{i}" for i in range(len(patterns))))))
