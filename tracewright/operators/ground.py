"""Verification of candidates from the facts themselves.

Every clause is evaluated afresh; nothing of a candidate is believed but which facts it
cites. The outcome of each clause, of the sequence and of the call grouping gives one of
three states: uncertainty beats failure, failure beats success. All patterns are matched and
verified in one projection of the trace rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Clause, Pattern
from .fingerprint import candidate_id
from .match import CITED, candidates, with_facts
from .metrics import OUTCOMES
from .predicates import bindings

VERIFIED, FAILED, UNAVAILABLE, UNSUPPORTED = "Verified", "Failed", "Unavailable", "Unsupported"
# The words for states and for the reasons of an abstention.
GROUNDED, ABSTAIN, UNGROUNDED = "grounded", "abstain", "ungrounded"
CATEGORIES = {UNAVAILABLE: "missing-fact", UNSUPPORTED: "unresolvable-layout", FAILED: "structural-mismatch"}
AMBIGUOUS = "ambiguous-attribution"

#: kind of predicate -> the facts that satisfy a clause. Registering a kind again replaces its verifier.
VERIFIERS: dict[str, Callable[[Clause], Column]] = {}


class UnsupportedVerifier(LookupError):
    """There are no verifiers at all."""


def register(kind: str, facts: Callable[[Clause], Column]) -> None:
    VERIFIERS[kind] = facts


for _kind in ("call", "storage", "value_flow", "token_transfer", "transaction", "log"):
    register(_kind, bindings)


def _string(s: str | None) -> Column:
    return F.lit(s).cast("string")


def _clause(p: Pattern, i: int, facts: Column | None, cited: Column) -> Column:
    """The verification of one clause: outcome, the supporting fact, the reason."""
    clause, polarity = p.clauses[i], p.polarity(i)
    none = F.lit(None).cast("struct<fact_kind: string, fact_id: int, ord: int, call_id: int>")

    def result(outcome: str, fact: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(i).alias("clause"), F.lit(clause.name).alias("name"), F.lit(clause.required).alias("required"),
            F.lit(outcome).alias("outcome"), fact.alias("fact"), reason.alias("reason"),
            F.array(*map(F.lit, clause.unresolved if outcome == UNSUPPORTED else [])).cast("array<string>").alias("unresolved"),
        )

    if facts is None:
        return result(UNSUPPORTED, none, F.lit(f"no verifier knows predicate `{clause.kind}`"))
    if polarity == "negative":
        absent = result(VERIFIED, none, F.lit("no fact satisfies the predicate, as the pattern requires"))
    else:
        absent = result(UNAVAILABLE, none, F.lit("no fact in the trace satisfies this predicate"))
    count = F.size(facts).cast("string")
    if clause.unresolved:
        said = F.concat(count, F.lit(f" matching fact(s), but {', '.join(clause.unresolved)} cannot be checked against the trace"))
        return F.when(F.size(facts) == 0, absent).otherwise(result(UNSUPPORTED, none, said))
    if polarity == "negative":
        first = F.get(facts, F.lit(0))
        return F.when(F.size(facts) == 0, absent).otherwise(result(FAILED, first, F.concat(count, F.lit(" fact(s) satisfy a predicate that the pattern wants absent"))))
    fact = F.get(F.filter(facts, lambda b: (b["fact_kind"] == cited["fact_kind"]) & (b["fact_id"] == cited["fact_id"])), F.lit(0))
    return (
        F.when(F.size(facts) == 0, absent)
        .when(cited.isNull(), result(VERIFIED, F.get(facts, F.lit(0)), F.lit("nothing was cited; a fact of the trace satisfies the predicate")))
        .when(fact.isNotNull(), result(VERIFIED, fact, F.lit("the cited fact satisfies the predicate")))
        .otherwise(result(FAILED, none, F.lit("the cited fact does not satisfy the predicate")))
    )


def _group(chain: Column, members: tuple[int, ...] | None, agree: Callable[[Column], Column]) -> Column:
    """The outcome for a sequence or a call group: the first member that isn't verified decides."""
    if not members:
        return _string(None)
    parts = [F.get(chain, F.lit(m)) for m in members]
    out = F.when(F.lit(False), _string(None))
    for m in parts:
        out = out.when(m["outcome"] != VERIFIED, m["outcome"]).when(m["fact"].isNull(), UNSUPPORTED)
    return out.when(agree(F.array(*(m["fact"] for m in parts))), VERIFIED).otherwise(FAILED)


def _in_order(facts: Column) -> Column:
    order = F.filter(F.transform(facts, lambda f: f["ord"]), lambda o: o.isNotNull())
    return order == F.array_sort(order)


def _one_call(facts: Column) -> Column:
    return F.size(F.array_distinct(F.transform(facts, lambda f: f["call_id"]))) == 1


def grounding(p: Pattern, facts: dict[int, Column | None], cited: Column, fields: tuple[str, ...] | None = None) -> Column:
    """The result for the citations of one candidate; only `fields` of it, if they are named."""

    def of(i: int) -> Column:
        return F.get(F.filter(cited, lambda b: b["clause"] == i), F.lit(0))

    chain = F.array(*(_clause(p, i, facts[i], of(i)) for i in range(len(p.clauses))))
    # `chain` is used many times below; a one-element transform computes it once.
    return F.get(F.transform(F.array(chain), lambda c: _result(p, c, fields)), F.lit(0))


def _result(p: Pattern, chain: Column, fields: tuple[str, ...] | None) -> Column:
    outcomes = F.struct(_group(chain, p.sequence, _in_order).alias("sequence"), _group(chain, p.same_call, _one_call).alias("same_call"))
    return F.get(F.transform(F.array(outcomes), lambda o: _status(p, chain, o["sequence"], o["same_call"], fields)), F.lit(0))


def _status(p: Pattern, chain: Column, sequence: Column, same_call: Column, fields: tuple[str, ...] | None) -> Column:
    uncertain = (UNAVAILABLE, UNSUPPORTED)
    required = F.filter(chain, lambda e: e["required"])
    groups = [(g, name) for g, name, used in ((sequence, "sequence", p.sequence), (same_call, "same_call", p.same_call)) if used]

    def some(values) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(g.isin(*values), F.lit(False)) for g, _ in groups], F.exists(required, lambda e: e["outcome"].isin(*values)))

    status = F.when(some(uncertain), ABSTAIN).when(some((FAILED,)), UNGROUNDED).otherwise(GROUNDED)
    category = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    reasons = F.transform(
        F.filter(required, lambda e: e["outcome"] != VERIFIED),
        lambda e: F.struct(F.element_at(category, e["outcome"]).alias("category"), e["clause"].alias("clause"), e["reason"].alias("detail")),
    )
    none = F.array().cast("array<struct<category: string, clause: int, detail: string>>")
    for g, name in groups:
        said = F.when(g == FAILED, f"the facts contradict the pattern's {name}").otherwise(f"the pattern's {name} could not be checked")
        one = F.array(F.struct(F.lit(AMBIGUOUS).alias("category"), F.lit(None).cast("int").alias("clause"), said.alias("detail")))
        reasons = F.concat(reasons, F.when(g != VERIFIED, one).otherwise(none))

    def count(needed: bool, verified: bool = False) -> Column:
        return F.size(F.filter(chain, lambda e: (e["required"] == needed) & (F.lit(not verified) | (e["outcome"] == VERIFIED))))

    def ids(outcome: str) -> Column:
        return F.transform(F.filter(chain, lambda e: e["outcome"] == outcome), lambda e: e["clause"])

    def note(g: Column, text: str, used) -> Column:
        return F.when(g == VERIFIED, f" {text} confirmed.").otherwise(f" {text} could not be confirmed.") if used else F.lit("")

    total, verified = count(True), count(True, True)
    # The sentence of the explanation.
    explanation = F.concat(
        F.lit(f"pattern `{p.id}` v{p.version}: "), status, F.lit(" ("), verified.cast("string"), F.lit("/"), total.cast("string"),
        F.lit(" required evidence clauses verified)."), note(sequence, "sequence ordering", p.sequence), note(same_call, "same_call correlation", p.same_call),
    )
    unresolved = F.flatten(F.transform(chain, lambda e: F.transform(e["unresolved"], lambda a: F.struct(e["clause"].alias("clause"), a.alias("attribute")))))
    made = {
        "status": status, "sequence_outcome": sequence, "same_call_outcome": same_call,
        "required_total": total, "required_verified": verified, "optional_total": count(False), "optional_verified": count(False, True),
        "verified": ids(VERIFIED), "failed": ids(FAILED), "unavailable": ids(UNAVAILABLE), "unsupported": ids(UNSUPPORTED),
        "abstain_reasons": F.when(status == ABSTAIN, reasons).otherwise(none), "unresolved_attributes": F.array_distinct(unresolved),
        "explanation": explanation, "chain": chain,
    }
    return F.struct(*(made[k].alias(k) for k in fields or made))


def _check(patterns: list[Pattern]) -> None:
    if not VERIFIERS:
        raise UnsupportedVerifier("no verifiers are registered")
    for p in patterns:
        for i in range(len(p.clauses)):
            p.polarity(i)  # a contradiction is an error, whatever the traces


def _findings(pos: int, p: Pattern, cited: Column, facts: dict[int, Column | None], fields: tuple[str, ...] | None = None) -> Column:
    """An array with the finding of each candidate."""

    def finding(c: Column, i: Column) -> Column:
        g = grounding(p, facts, c, fields)
        named = {"pattern_pos": pos, "pattern_id": p.id, "pattern_version": p.version, "pattern_family": p.family, "pattern_severity": p.severity}
        return F.struct(*(F.lit(v).alias(k) for k, v in named.items()), i.alias("candidate_pos"), c.alias("bindings"), g.alias("g"))

    return F.transform(cited, finding)


_FLAT = ("trace_id", "pattern_pos", "pattern_id", "pattern_version", "pattern_family", "pattern_severity", "candidate_pos", "bindings", "g.*")


def _found(traces: DataFrame, patterns: list[Pattern], fields: tuple[str, ...] | None) -> DataFrame:
    """Trace rows with the findings of pattern i in column _found{i}."""
    _check(patterns)
    rows, facts = with_facts(traces, [p.check_bounds() for p in patterns])
    # Where a verifier is the function that matching uses, its column is there already.
    others = {f"_seen{i}_{k}": VERIFIERS[c.kind](c) for i, p in enumerate(patterns) for k, c in enumerate(p.clauses) if VERIFIERS.get(c.kind, bindings) is not bindings}
    rows = rows.withColumns({f"_cited{i}": candidates(p, facts[i]) for i, p in enumerate(patterns)} | others)

    def seen(i: int, k: int, c: Clause) -> Column | None:
        return None if c.kind not in VERIFIERS else F.col(f"_seen{i}_{k}") if f"_seen{i}_{k}" in others else facts[i][k]

    return rows.withColumns(
        {f"_found{i}": _findings(i, p, F.col(f"_cited{i}"), {k: seen(i, k, c) for k, c in enumerate(p.clauses)}, fields) for i, p in enumerate(patterns)}
    )


def match_and_ground(traces: DataFrame, patterns: list[Pattern], ids: bool = True, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each candidate of each pattern, with its grounding: one projection of the traces, no
    shuffle. Where only some fields of the grounding are wanted, naming them saves making the others."""
    found = _found(traces, patterns, fields).select("trace_id", F.inline(F.concat(*(f"_found{i}" for i in range(len(patterns))))))
    return candidate_id(found.select(*_FLAT)) if ids else found.select(*_FLAT)


def outcomes(traces: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """trace_id, pattern_pos, pattern_family, candidates, actual for each trace and pattern: the number
    of candidates and their strongest status, no-match if there are none. One projection, no shuffle."""

    def one(i: int, p: Pattern) -> Column:
        statuses = F.transform(f"_found{i}", lambda f: f["g"]["status"])
        best = F.lit(OUTCOMES[-1])
        for o in reversed(OUTCOMES[:-1]):
            best = F.when(F.array_contains(statuses, o), o).otherwise(best)
        family = F.when(F.size(statuses) > 0, p.family)
        return F.struct(F.lit(i).alias("pattern_pos"), family.alias("pattern_family"), F.size(statuses).cast("long").alias("candidates"), best.alias("actual"))

    return _found(traces, patterns, ("status",)).select("trace_id", F.inline(F.array(*(one(i, p) for i, p in enumerate(patterns)))))


class GroundingError(ValueError):
    """Candidates that no pattern or no fact stands behind."""


def ground(traces: DataFrame, patterns: list[Pattern], given: DataFrame, strict: bool = True) -> DataFrame:
    """Ground candidates from elsewhere: trace_id, pattern_id, pattern_version, candidate_pos, bindings.

    Candidates of unknown patterns, and cited facts that their trace does not hold, are an
    error, as one bad candidate makes a batch suspect. With strict=False they are left out.
    """
    known = {(p.id, p.version) for p in patterns}
    key = F.struct(F.col("pattern_id"), F.col("pattern_version").cast("int"))
    of_known = reduce(lambda a, b: a | b, [(F.col("pattern_id") == i) & (F.col("pattern_version") == v) for i, v in known], F.lit(False))
    if strict and not given.where(~of_known).isEmpty():
        raise GroundingError("a candidate is of no pattern that was given (id and version must be equal)")

    def there(b: Column) -> Column:
        sizes = {"Call": "calls", "StorageChange": "storage_changes", "Log": "logs", "TokenTransfer": "token_transfers"}
        return reduce(lambda a, x: a | ((b["fact_kind"] == x[0]) & (b["fact_id"] >= 0) & (b["fact_id"] < F.size(x[1]))), sizes.items(), F.lit(False))

    asked = given.where(of_known).groupBy("trace_id", "pattern_id", F.col("pattern_version").cast("int").alias("pattern_version")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("candidate_pos", F.col("bindings").cast(CITED).alias("b")))), lambda x: x["b"]).alias("_cited")
    )
    rows = traces.join(asked, "trace_id")
    whole = F.forall("_cited", lambda c: F.forall(c, there))
    if strict and not rows.where(~whole).isEmpty():
        raise GroundingError("a candidate cites a fact that its trace does not hold")
    _check(patterns)

    def of(pos: int, p: Pattern) -> Column:
        known = [i for i, c in enumerate(p.clauses) if c.kind in VERIFIERS]
        made = F.struct(F.lit(0).alias("_"), *(VERIFIERS[p.clauses[i].kind](p.clauses[i]).alias(f"f{i}") for i in known))
        # A one-element transform computes the facts once, and only for the row's own pattern.
        return F.flatten(F.transform(F.array(made), lambda f: _findings(pos, p, F.col("_cited"), {i: f[f"f{i}"] if i in known else None for i in range(len(p.clauses))})))

    found = F.when(F.lit(False), F.lit(None))
    for pos, p in enumerate(patterns):
        found = found.when((F.col("pattern_id") == p.id) & (F.col("pattern_version") == p.version), of(pos, p))
    return candidate_id(rows.where(whole).select("trace_id", F.inline(found)).select(*_FLAT))
