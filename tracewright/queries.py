"""Queries over traces derived from the order tables: one for each operator of the engine.

SQL for the same rows is in oracle.py.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hexcodec import kind_class
from .model import Relations, rows_of, to_relations, to_traces
from .operators import integrity, metrics
from .operators.enrich import enrich_traces, enriched_calls
from .operators.ground import ground, match_and_ground, outcomes
from .operators.match import find_candidates
from .operators.predicates import SOURCES, bindings, select_facts
from .operators.taxonomy import DEFAULT, SCWE
from .plans.compiler import Pattern, compile_pattern
from .sources import lens
from .sources.calltracer import ingest_call_tracer
from .sources.documents import ingest, traces_of
from .sources.library import EXAMPLES, SHIPPED, load_pattern_file, load_patterns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def _text(name: str, evidence: str, *rest: str) -> str:
    return f"pattern {name} version 1 {{ family: Reentrancy severity: Low evidence {{ {evidence} }} {' '.join(rest)} }}"


@lru_cache
def shipped() -> tuple[Pattern, ...]:
    return tuple(load_patterns())


# ------------------------------------------------------------------ predicates, as filters and joins of relations

PREDICATES = {
    "call_kind": "call(kind: Delegate)",
    "call_kind_internal": "call(kind: Internal)",
    "call_reentrant": "call(kind: External, reentrant: true)",
    "call_value_flow_in": "call(kind: External, value_flow: In)",
    "call_value_flow_out": "call(kind: External, value_flow: Out)",
    "call_min_value": "call(kind: External, min_value: 25)",
    "call_selector": 'call(kind: External, selector: "0x00000003")',
    "call_selector_malformed": 'call(kind: External, selector: "0x03")',
    "call_succeeded": "call(kind: Create, succeeded: true)",
    "call_parent_kind": "call(kind: SelfDestruct, parent_kind: Delegate)",
    "call_ancestor_kind": "call(kind: SelfDestruct, ancestor_kind: Delegate)",
    "storage_changed": "storage(changed: true)",
    "storage_unchanged": "storage(changed: false)",
    "storage_slot": f'storage(changed: true, slot: "0x{"0" * 64}")',
    "storage_call_kind": "storage(changed: true, call_kind: Delegate)",
    "value_flow_minmax": "value_flow(direction: Out, min: 10, max: 40)",
    "token_transfer_direction": "token_transfer(direction: In)",
    "token_transfer_token": f'token_transfer(direction: Out, token: "0x{"0" * 39}2")',
    "transaction_status_gas": "transaction(status: Success, gas_used_min: 100000)",
    "log_topic0": f'log(topic0: "{lens.OTHER_TOPIC}")',
    "log_decoded_true": f'log(topic0: "{lens.TRANSFER_TOPIC}", decoded: true)',
    "log_decoded_false": f'log(topic0: "{lens.TRANSFER_TOPIC}", decoded: false)',
}


# Predicates that stay joins of relations: with the transaction, and a semi-join with the transfers.
JOINED = ("call_value_flow_in", "log_decoded_true")
# Fields of calls that a predicate reads, where they have other names than its attributes.
_READ = {"selector": {"selector"}, "succeeded": {"succeeded"}, "min_value": {"value_hex"}, "min": {"value_hex"}, "max": {"value_hex"}}


def _predicate_query(name: str, predicate: str) -> Query:
    """A predicate's facts, as a projection of trace rows in which only the fields it reads are made; or as joins of relations."""
    clause = compile_pattern(_text(name, f"required fact: {predicate}")).clauses[0]
    read = set().union(*(_READ.get(k, set()) for k in clause.attributes)) | ({"value_hex"} if clause.kind == "value_flow" else set()) | lens.WALKED

    def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = lens.relations(spark, sf_dir)
        facts = {"calls": r.calls, "storage_changes": r.storage_changes, "logs": r.logs, "token_transfers": r.token_transfers}
        return select_facts(clause, facts[SOURCES[clause.kind].array], r.tx, r.calls, r.token_transfers)

    def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
        deep = {"reentrant", "ancestor_kind", "parent_kind"} & clause.attributes.keys()
        rows = (lens.traces if deep else lens.raw_traces)(spark, sf_dir, read)
        return rows.select("trace_id", rows_of(bindings(clause)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = (joined if name in JOINED else projected)(spark, sf_dir)
        return found.select("trace_id", "fact_kind", "fact_id", F.coalesce("ord", F.lit(-1)).alias("ord"), "call_id")  # -1: a fact of the transaction, without a place in order

    return run


for _name, _predicate in PREDICATES.items():
    QUERIES[_name] = _predicate_query(_name, _predicate)


# ------------------------------------------------------------------ relations and what derives from them


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_calls(lens.traces(spark, sf_dir, lens.WALKED))


@query("parent_join")
def parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("trace_id", "call_id", kind_class(F.col("kind")).alias("kind_class"), kind_class(F.col("parent_kind")).alias("parent_class"))


@query("reentrancy")
def reentrancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("trace_id", "call_id", "reentrant")


@query("storage_context")
def storage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("trace_id", "call_id", "context")


@query("depth")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls are above each."""
    return _calls(spark, sf_dir).select("trace_id", "call_id", F.col("level").alias("depth"))


@query("transfer_decode")
def transfer_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lens.relations(spark, sf_dir)
    return r.token_transfers.select("trace_id", "id", "log_id", "call_id", "token", "from_addr", "to_addr", "amount_hex")


@query("children_of")
def children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.relations(spark, sf_dir).children_of(1).select("trace_id", "call_id", "parent_id")


@query("fact_lookup")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the storage change that its number names, and the call that made it; orders that name none are left out."""
    r = lens.relations(spark, sf_dir)
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderkey") % 3).cast("int").alias("id"))
    changes = r.lookup("storage_changes", keys)
    made = r.lookup("calls", changes.select("trace_id", F.col("call_id").alias("id")).distinct())
    return changes.select("trace_id", "id", "call_id").join(made.select("trace_id", "call_id", "kind"), ["trace_id", "call_id"])


@query("value_flows")
def value_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.relations(spark, sf_dir).value_flows()


@query("net_value_extracted")
def net_value_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = metrics.net_values(to_relations(lens.raw_traces(spark, sf_dir, {"from_addr", "to_addr", "value_hex"})).calls)
    return net.select("trace_id", "address", F.col("net").cast("long").alias("net"))


@query("net_value_wide")
def net_value_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of 2^121 and its multiples: totals beyond 38 digits, and some beyond 128 signed bits."""
    calls = to_relations(lens.raw_traces(spark, sf_dir, {"from_addr", "to_addr", "value_hex"})).calls
    units = F.conv(F.substring("value_hex", 31, 2), 16, 10).cast("long")
    wide = F.concat(F.lower(F.lpad(F.hex(units * 2), 2, "0")), F.lit("0" * 30))
    net = metrics.net_values(calls.withColumn("value_hex", wide))
    return net.select("trace_id", "address", F.coalesce("net_digits", F.lit("none")).alias("net_digits"))


@query("arena_integrity")
def arena_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lens's traces, some of them broken on purpose, by the first rule that they break."""
    traces = lens.raw_traces(spark, sf_dir)
    odd = F.transform("storage_changes", lambda s: s.withField("call_id", s["call_id"] + 1000))
    twice = F.transform("logs", lambda x: x.withField("log_index", F.lit(7).cast("long")))
    roots = F.transform("calls", lambda c: c.withField("parent_id", F.when(c["call_id"] == 2, F.lit(None).cast("int")).otherwise(c["parent_id"])))
    k = F.col("trace_id") % 5
    broken = traces.withColumns(
        {
            "storage_changes": F.when(k == 1, odd).otherwise(F.col("storage_changes")),
            "logs": F.when(k == 2, twice).otherwise(F.col("logs")),
            "calls": F.when(k == 3, roots).otherwise(F.col("calls")),
        }
    )
    return integrity.check(broken, check_depth=False).select("trace_id", F.coalesce("error", F.lit("none")).alias("error"))


@query("dangling_references")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage changes whose call is a static call, found as those with no other call to belong to."""
    r = lens.relations(spark, sf_dir)
    return integrity.dangling(r.storage_changes, r.calls.where("kind <> 'StaticCall'")).select("trace_id", "id", "call_id")


@query("relations_round_trip")
def relations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r: Relations = to_relations(lens.raw_traces(spark, sf_dir))
    return r.calls.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("succeeded").alias("n_succeeded"))


@query("trace_summary")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trace_summary(lens.raw_traces(spark, sf_dir)).drop("tx_hash", "block_number", "chain_id")


# ------------------------------------------------------------------ documents


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lens's traces as documents, some of them broken on purpose, read back."""
    rows = lens.raw_traces(spark, sf_dir)
    k = F.col("trace_id") % 16
    static = F.transform("calls", lambda c: F.when(c["kind"] == "StaticCall", c.withField("value_hex", F.lit("0" * 31 + "1"))).otherwise(c))
    odd = F.transform("calls", lambda c: F.when(c["call_id"] == 0, c.withField("kind", F.lit("jump"))).otherwise(c))
    twice = F.transform("logs", lambda x: x.withField("log_index", F.lit(7).cast("long")))
    broken = rows.withColumns(
        {"calls": F.when(k == 2, odd).when(k == 6, static).otherwise(F.col("calls")), "logs": F.when(k == 3, twice).otherwise(F.col("logs"))}
    )
    doc = F.col("doc")
    spoiled = (
        F.when(k == 1, F.substring(doc, 1, F.length(doc) - 1))
        .when(k == 4, F.regexp_replace(doc, '"contract":"0x0', '"contract":"0xf'))
        .when(k == 5, F.regexp_replace(doc, '"nonce":"0x0"', '"nonce":"0xzz"'))
        .when(k == 7, F.regexp_replace(doc, '"status":"[a-z]*"', r'"status":"\\\\ud800"'))  # half of a surrogate pair
        .when(k == 8, F.regexp_replace(doc, '"block":', '"more":1,"block":'))
        .otherwise(doc)
    )
    return ingest(lens.documents(broken).withColumn("doc", spoiled))


@query("ingest_outcomes")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"calls": "n_calls", "storage_changes": "n_changes", "logs": "n_logs", "token_transfers": "n_transfers"}
    good = F.col("error_kind").isNull()
    return _ingested(spark, sf_dir).select(
        F.col("trace_id").cast("long").alias("trace_id"), F.coalesce("error_kind", F.lit("none")).alias("error_kind"), *(F.when(good, F.size(k)).otherwise(-1).alias(v) for k, v in sizes.items())
    )


@query("ingest_calls")
def ingest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = enriched_calls(traces_of(_ingested(spark, sf_dir)))
    return calls.select(F.col("trace_id").cast("long").alias("trace_id"), "call_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "kind", "depth", "succeeded", "selector", "value_hex", "context")


@query("ingest_nested_calls")
def ingest_nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose calls nest as they were made: ids in visiting order, contexts inherited over levels."""
    found = traces_of(ingest(lens.nested_documents(lens.raw_traces(spark, sf_dir))))
    changes = lambda c: F.size(F.filter("storage_changes", lambda s: (s["call_id"] == c["call_id"]) & (s["contract"] == c["context"])))
    rows = found.select(F.col("trace_id").cast("long").alias("trace_id"), F.explode(F.transform("calls", lambda c: F.struct(c.alias("c"), changes(c).alias("n_changes")))).alias("x"))
    named = {n: F.col(f"x.c.{n}") for n in ("call_id", "kind", "depth", "selector", "value_hex", "context")}
    return rows.select("trace_id", *(c.alias(n) for n, c in named.items()), F.coalesce("x.c.parent_id", F.lit(-1)).alias("parent_id"), "x.n_changes")


@query("ingest_call_tracer")
def ingest_tracer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracer's output with receipts joined by hash. One in five transactions has no receipt; one in seven documents is cut short, one in eleven has another kind of call at its root."""
    docs = lens.tracer_documents(lens.raw_traces(spark, sf_dir))
    k = F.conv(F.substring("trace_id", -12, 12), 16, 10).cast("long")
    doc = F.col("doc")
    spoiled = docs.withColumn("doc", F.when(k % 7 == 3, F.substring(doc, F.lit(1), F.length(doc) - 1)).when(k % 11 == 3, F.regexp_replace(doc, '"result":\\{"type":"CALL"', '"result":{"type":"JUMP"')).otherwise(doc))
    known = lens.receipts(spark, sf_dir).where(F.conv(F.substring("tx_hash", -12, 12), 16, 10).cast("long") % 5 != 0)
    rows = ingest_call_tracer(spoiled, block_number="0x7", context=known)
    number = lambda c: F.coalesce(F.col(f"tx.{c}").cast("long"), F.lit(-1))
    calls = F.transform("calls", lambda c: F.concat_ws(":", c["depth"].cast("string"), F.lower(c["kind"]), c["succeeded"].cast("string")))
    return rows.select(
        "trace_id", F.coalesce("error_kind", F.lit("none")).alias("error_kind"), number("nonce").alias("nonce"), number("block_number").alias("block_number"),
        number("block_ts").alias("block_ts"), number("chain_id").alias("chain_id"), F.coalesce("tx.status", F.lit("none")).alias("status"), F.coalesce(F.array_join(calls, ";"), F.lit("")).alias("calls"),
    )


@query("broken_relations")
def broken_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in which one trace in six has a call whose parent comes later, one in six a circle of two, one in six a parent
    that is not there: error rows, and no facts; the others have their re-entries."""
    r = lens.relations(spark, sf_dir)
    k, own = F.col("trace_id") % 6, F.col("call_id")
    parent = F.when((k == 1) & (own == 1), own + 1).when((k == 2) & own.isin(1, 2), 3 - own).when((k == 3) & (own == 1), 1000).otherwise(F.col("parent_id"))
    rows = to_traces(Relations(r.tx, r.calls.withColumn("parent_id", parent), r.storage_changes, r.logs, r.token_transfers))
    checked = enrich_traces(rows.withColumn("error", integrity.first_error(check_depth=False)))
    again = F.size(F.filter("calls", lambda c: c["reentrant"]))
    return checked.select("trace_id", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce(again, F.lit(-1)).alias("n_reentrant"))


# ------------------------------------------------------------------ matching and grounding

_TRANSFER = lens.TRANSFER_TOPIC
PATTERNS = {
    "constraint_and": _text(
        "constraint_and", "required failed: call(kind: External, succeeded: false) required written: storage(changed: true)", "constraint: AND(failed, written)"
    ),
    "constraint_or": _text(
        "constraint_or", f'required gone: call(kind: SelfDestruct) required sent: log(topic0: "{_TRANSFER}", decoded: true)', "constraint: OR(gone, sent)"
    ),
    "constraint_not": _text(
        "constraint_not", "required failed: call(kind: External, succeeded: false) optional borrowed: call(kind: Delegate)", "constraint: AND(failed, NOT(borrowed))"
    ),
    "global_negated": _text("global_negated", "required gone: call(kind: SelfDestruct)", "constraint: NOT(gone)"),
    "sequence": _text(
        "in_sequence",
        "required made: call(kind: Create) required written: storage(changed: true) required gone: call(kind: SelfDestruct)",
        "sequence: [made, written, gone]",
    ),
    "same_call": _text(
        "in_same_call", 'required asked: call(kind: External, selector: "0x00000003") required written: storage(changed: true)', "same_call: [asked, written]"
    ),
}


def _flat(bindings) -> F.Column:
    return F.array_join(F.transform(bindings, lambda b: F.concat_ws(":", b["clause"].cast("string"), b["fact_kind"], b["fact_id"].cast("string"))), ";")


def _candidate_query(p: Callable[[], Pattern], source: Query = lens.traces) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find_candidates(source(spark, sf_dir), [p()]).select("trace_id", "candidate_pos", _flat("bindings").alias("bindings"))

    return run


def _grounding_query(p: Callable[[], Pattern], source: Query = lens.traces) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = ("status", "required_total", "required_verified", "explanation", "abstain_reasons")
        found = match_and_ground(source(spark, sf_dir), [p()], ids=False, fields=wanted)
        return found.select("trace_id", "candidate_pos", "status", "required_total", "required_verified", "explanation", F.size("abstain_reasons").alias("n_reasons"))

    return run


for _name, _source in PATTERNS.items():
    QUERIES[_name] = _candidate_query(lambda s=_source: compile_pattern(s))
    QUERIES[f"grounding_{_name}"] = _grounding_query(lambda s=_source: compile_pattern(s))
for _path in sorted(SHIPPED.glob("*.rcdsl")):
    QUERIES[f"candidates_{_path.stem}"] = _candidate_query(lambda p=_path: load_pattern_file(p))
    QUERIES[f"grounding_{_path.stem}"] = _grounding_query(lambda p=_path: load_pattern_file(p))


def _upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose selector 3 is the one that the example patterns look for."""
    renamed = F.transform("calls", lambda c: c.withField("selector", F.when(c["selector"] == "0x00000003", "0x3659cea8").otherwise(c["selector"])))
    return lens.traces(spark, sf_dir).withColumn("calls", renamed)


for _path in sorted(EXAMPLES.glob("*.rcdsl")):
    QUERIES[f"candidates_{_path.stem}"] = _candidate_query(lambda p=_path: load_pattern_file(p), _upgrades)
    QUERIES[f"grounding_{_path.stem}"] = _grounding_query(lambda p=_path: load_pattern_file(p), _upgrades)


@query("evidence_chain")
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clause of each candidate: what was verified, by which fact, and why a finding abstains."""
    found = match_and_ground(lens.traces(spark, sf_dir), [compile_pattern(PATTERNS["constraint_or"])], ids=False)
    links = found.select("trace_id", "candidate_pos", "abstain_reasons", F.explode("chain").alias("e"))
    why = F.get(F.filter("abstain_reasons", lambda r: r["clause"] == F.col("e.clause")), F.lit(0))["category"]
    return links.select("trace_id", "candidate_pos", "e.clause", "e.name", "e.outcome", F.col("e.fact.fact_id").cast("string").alias("fact"), why.alias("category"))


@query("grounding_fabricated")
def grounding_fabricated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up candidate for each trace that cites its root call: grounded nowhere, as a root is no self-destruct."""
    traces = lens.traces(spark, sf_dir)
    p = load_pattern_file(SHIPPED / "unsafe_selfdestruct.rcdsl")
    cited = F.array(F.struct(F.lit(0).alias("clause"), F.lit("Call").alias("fact_kind"), F.lit(0).alias("fact_id")))
    given = traces.select("trace_id", F.lit(p.id).alias("pattern_id"), F.lit(p.version).alias("pattern_version"), F.lit(0).alias("candidate_pos"), cited.alias("bindings"))
    return ground(traces, [p], given, strict=False).select("trace_id", "status", "required_verified")


@query("flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped patterns on all traces: statuses, and the registry entries of their families."""
    patterns = list(shipped())
    counts = match_and_ground(lens.traces(spark, sf_dir), patterns, ids=False, fields=("status",)).groupBy("pattern_id", "pattern_family", "status").agg(F.count("*").alias("n"))
    named = DEFAULT.attach(counts, [p.family for p in patterns])
    return named.select("pattern_id", "status", "n", F.array_join(F.transform("taxonomy", lambda t: t["code"]), ",").alias("codes"))


@query("candidate_ids")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of candidates with one citation and with two."""
    found = match_and_ground(lens.traces(spark, sf_dir), [load_pattern_file(SHIPPED / f"{p}.rcdsl") for p in ("unsafe_selfdestruct", "classic_reentrancy")])
    return found.select("trace_id", "pattern_id", "candidate_pos", "candidate_id")


# ------------------------------------------------------------------ taxonomy and metrics


@query("taxonomy_join")
def taxonomy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order stands for a finding of a family by its number, some of families that no registry knows; its codes, and the registries without one."""
    names = [e[0] for e in SCWE] + ["UnknownFamily", "reentrancy", ""]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    family = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names)).cast("int"))
    found = orders.select(family.alias("pattern_family"), F.col("o_orderstatus").alias("status"))
    named = DEFAULT.attach(found, names).select(
        "pattern_family", "status", F.array_join(F.transform("taxonomy", lambda t: t["code"]), ",").alias("codes"), F.array_join("unmapped", ",").alias("unmapped")
    )
    return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


SCORED = ("unsafe_selfdestruct", "delegatecall_reachable_selfdestruct", "unchecked_external_call", "oracle_manipulation")


def _scored() -> list[Pattern]:
    return [load_pattern_file(SHIPPED / f"{p}.rcdsl") for p in SCORED]


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace with every pattern of SCORED; what is expected follows from their numbers, and one in five is not scored."""
    rows = outcomes(lens.traces(spark, sf_dir), _scored())
    names = F.array(*map(F.lit, SCORED))
    expected = F.get(F.array(*map(F.lit, metrics.OUTCOMES)), ((F.col("trace_id") + F.col("pattern_pos")) % 5).cast("int"))
    return rows.select(
        (F.col("trace_id") * len(SCORED) + F.col("pattern_pos")).alias("seq"), F.col("trace_id").alias("case_id"), F.get(names, F.col("pattern_pos")).alias("pattern_id"),
        F.col("pattern_family").alias("family"), "candidates", expected.alias("expected"), "actual",
    )


@query("outcome_strongest")
def outcome_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By grouping findings, as a suite does; scored_results has the same without a shuffle."""
    traces = lens.traces(spark, sf_dir)
    best = metrics.strongest(match_and_ground(traces, _scored(), ids=False, fields=("status",)), "trace_id", "pattern_pos")
    every = traces.select("trace_id", F.explode(F.array(*(F.lit(i) for i in range(len(SCORED))))).alias("pattern_pos"))
    rows = every.join(best, ["trace_id", "pattern_pos"], "left")
    names = F.array(*map(F.lit, SCORED))
    return rows.select(
        F.col("trace_id").alias("case_id"), F.get(names, F.col("pattern_pos")).alias("pattern_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("actual", F.lit("no-match")).alias("actual"),
    )


@query("confusion_matrix")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored_results(spark, sf_dir))


@query("confusion_matrix_dense")
def confusion_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dense_confusion(scored_results(spark, sf_dir)).drop("place")


@query("precision_recall_f1")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scores(scored_results(spark, sf_dir)).select("tp", "fp", "fn", "tn", "total", "correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query("per_pattern")
def per_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_pattern(scored_results(spark, sf_dir)).select("pattern_id", "runs", "passed", "candidates", F.round("accuracy", 9).alias("accuracy"))


@query("per_family")
def per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_family(scored_results(spark, sf_dir)).select("family", "runs", "passed", F.round("accuracy", 9).alias("accuracy"))


@query("failures")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(scored_results(spark, sf_dir)).where("expected <> actual").select("case_id", "pattern_id", "expected", "actual")


@query("case_passed")
def case_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = F.bool_and(F.coalesce(F.col("expected") == F.col("actual"), F.lit(True)))
    return scored_results(spark, sf_dir).groupBy("case_id").agg(matched.alias("passed"), F.count("expected").alias("n_scored"))
