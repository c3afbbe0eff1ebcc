import copy
import json
import random

import pytest
from pyspark.sql import functions as F
from traces import CORPUS, OTHER, SENDER, TRANSFER, VICTIM, call, document, log, text, topic, word, write

from tracewright.functions import hexcodec
from tracewright.functions.hexcodec import KIND_CLASSES
from tracewright.model import CALL, array_type, columns_of, to_relations
from tracewright.operators.enrich import enrich_traces
from tracewright.sources.calltracer import convert, ingest_call_tracer
from tracewright.sources.documents import Files, IngestionError, errors_of, in_memory, ingest, ingest_from, read_files, traces_of

ROOT = call("call", SENDER, VICTIM, writes=[write(VICTIM)], logs=[log(VICTIM, [word(1)], "0x00", 3)])


def changed(path: str, value) -> str:
    doc = copy.deepcopy(document(ROOT))
    *way, last = path.split(".")
    at = doc
    for k in way:
        at = at[int(k) if k.isdigit() else k]
    at[last] = value
    return json.dumps(doc)


def flat(spark, docs):
    """Ingested rows by trace id, from texts by trace id."""
    return {r["trace_id"]: r for r in ingest(in_memory(spark, docs)).collect()}


def test_errors(spark):
    wanted = [
        ("{", "MalformedInput"),
        ("[]", "MalformedInput"),
        ("7", "MalformedInput"),
        ("", "MalformedInput"),
        (text(ROOT) + " {}", "MalformedInput"),
        (text(ROOT) + "]", "MalformedInput"),
        (text(ROOT) + "}", "MalformedInput"),
        (text(ROOT) + "], [{}", "MalformedInput"),
        (text(ROOT).replace('"block"', '"block": {}, "block"'), "MalformedInput"),
        (changed("transaction.extra", 1), "MalformedInput"),
        (changed("root.calls", None), "MalformedInput"),
        (changed("root.calls", [7]), "MalformedInput"),
        (changed("root.logs", {}), "MalformedInput"),
        (changed("root.logs.0.topics", [1]), "MalformedInput"),
        (changed("root.storageChanges.0.more", "x"), "MalformedInput"),
        (changed("root.from", 5), "MalformedInput"),
        (changed("root.from", None), "MalformedInput"),
        (changed("block", "x"), "MalformedInput"),
        (changed("root.succeeded", "yes"), "MalformedInput"),
        (changed("transaction.hash", "0x12"), "MalformedField"),
        (changed("transaction.status", "Success"), "MalformedField"),
        (changed("transaction.nonce", "0x1" + "0" * 16), "MalformedField"),
        (changed("transaction.nonce", "0x1\n"), "MalformedField"),
        (changed("transaction.value", "0X1"), "MalformedField"),
        (changed("block.number", ""), "MalformedField"),
        (changed("root.kind", "jump"), "UnsupportedFeature"),
        (changed("root.kind", "delegatecall"), "UnsupportedFeature"),
        (changed("root.input", "0x123"), "MalformedField"),
        (changed("root.value", "0x1" + "0" * 32), "MalformedField"),
        (changed("root.storageChanges.0.contract", OTHER), "InvalidStorageOwnership"),
        (changed("root.logs.0.topics", [word(1)] * 5), "MalformedField"),
        (changed("root.logs.0.topics", [word(1), "0x1"]), "MalformedField"),
        (changed("root.logs.0.logIndex", "0x100000000"), "MalformedField"),
        (changed("root.logs", [log(VICTIM, [], "0x", 1), log(VICTIM, [], "0x", 1)]), "DuplicateLogIndex"),
        (text(call("call", SENDER, VICTIM, call("staticcall", VICTIM, OTHER, value=1))), "ArenaConstruction"),
        (changed("root.to", None), "InvalidStorageOwnership"),
        (changed("block.baseFee", "0xff"), None),
    ]
    got = flat(spark, {str(i): doc for i, (doc, _) in enumerate(wanted)})
    assert [(doc, got[str(i)]["error_kind"]) for i, (doc, _) in enumerate(wanted)] == wanted
    assert all((got[str(i)]["calls"] is None) == (kind is not None) for i, (_, kind) in enumerate(wanted))


def test_first_error_wins(spark):
    doc = document(call("jump", "no", VICTIM, writes=[write(OTHER)]))
    later = copy.deepcopy(doc)
    later["transaction"]["hash"] = "zz"
    deep = document(call("call", SENDER, VICTIM, call("call", SENDER, "zz"), call("jump", SENDER, VICTIM), writes=[write(VICTIM, 2) | {"slot": "0x2"}], logs=[log("0x", [], "0x")]))
    unchanged = copy.deepcopy(deep)
    unchanged["root"]["storageChanges"] = []
    unlogged = copy.deepcopy(unchanged)
    unlogged["root"]["logs"] = []
    got = flat(spark, {k: json.dumps(d) for k, d in {"kind": doc, "hash": later, "slot": deep, "log": unchanged, "call": unlogged}.items()})
    assert [k for k, part in (("kind", "jump"), ("hash", "transaction.hash"), ("slot", "storageChange.slot"), ("log", "log.address"), ("call", "call.to")) if part not in got[k]["error"]] == []


def test_ids_depth_and_context_follow_the_tree(spark):
    inner = call("delegatecall", VICTIM, OTHER, call("callcode", VICTIM, OTHER, writes=[write(VICTIM)], logs=[log(OTHER, [], "0x", 4)]))
    got = flat(spark, {"t": text(call("call", SENDER, VICTIM, inner, call("create", VICTIM, None, writes=[write(VICTIM, 1)], logs=[log(OTHER, [], "0xAB", 2)]), data="0xA9059CBB00"))})["t"]
    assert [(c["call_id"], c["parent_id"], c["depth"], c["kind"]) for c in got["calls"]] == [
        (0, None, 0, "Call"), (1, 0, 1, "DelegateCall"), (2, 1, 2, "CallCode"), (3, 0, 1, "Create"),
    ]
    assert got["calls"][0]["selector"] == "0xa9059cbb" and got["calls"][1]["selector"] is None
    assert [(s["id"], s["call_id"]) for s in got["storage_changes"]] == [(0, 2), (1, 3)]
    assert [(x["id"], x["call_id"], x["log_index"], x["data"]) for x in got["logs"]] == [(0, 2, 4, ""), (1, 3, 2, "ab")]


def _plain_tree(frame, parent=None, depth=0, outer=None, out=None):
    """A recursive walk: (parent, depth, kind, context) of each call, in visiting order."""
    out = [] if out is None else out
    me, context = len(out), outer if frame["kind"] in ("delegatecall", "callcode") else frame["to"] or frame["from"]
    out.append((parent, depth, frame["kind"], context))
    for c in frame["calls"]:
        _plain_tree(c, me, depth + 1, context, out)
    return out


def test_random_trees_against_a_plain_walk(spark):
    """Wide, deep and large trees; each call writes to its own context, or the document is refused."""
    rng, addresses = random.Random(6), [SENDER, VICTIM, OTHER, "0x" + "dd" * 20]

    def tree(n, pick):
        frames = [call("call" if i == 0 else rng.choice(["call", "delegatecall", "callcode", "create", "staticcall"]), rng.choice(addresses), rng.choice([*addresses, None]) if i else VICTIM) for i in range(n)]
        for i in range(1, n):
            frames[pick(i)]["calls"].append(frames[i])
        return frames[0]

    trees = {f"random{k}": tree(40, lambda i: rng.randrange(i)) for k in range(8)} | {"chain": tree(120, lambda i: i - 1), "wide": tree(300, lambda i: 0), "large": tree(2000, lambda i: rng.randrange(max(0, i - 50), i))}
    for root in trees.values():
        left = [(root, None)]
        while left:
            f, outer = left.pop()
            context = outer if f["kind"] in ("delegatecall", "callcode") else f["to"] or f["from"]
            f["storageChanges"] = [write(context)]
            left += [(c, context) for c in f["calls"]]
    got = flat(spark, {k: text(t) for k, t in trees.items()})
    for k, root in trees.items():
        wanted = _plain_tree(root)
        assert got[k]["error"] is None
        assert [(c["parent_id"], c["depth"], c["kind"].lower()) for c in got[k]["calls"]] == [w[:3] for w in wanted], k
        assert [(s["call_id"], s["contract"]) for s in got[k]["storage_changes"]] == [(i, w[3]) for i, w in enumerate(wanted)], k


def test_nesting_beyond_the_parser_is_malformed(spark):
    frame, end = text(ROOT).split('"calls": []')
    docs = {str(n): frame.split('"root": ')[0] + '"root": ' + (json.dumps(call("call", SENDER, VICTIM)).replace('"calls": []}', '"calls": [')) * n + json.dumps(call("call", SENDER, VICTIM)) + "]}" * n + "}" for n in (400, 700)}
    got = flat(spark, docs)
    assert len(got["400"]["calls"]) == 401 and got["400"]["calls"][400]["depth"] == 400
    assert got["700"]["error_kind"] == "MalformedInput"


def test_bulk_ingestion_keeps_errors_apart(spark, tmp_path):
    docs = {name: doc for name, (doc, _) in CORPUS.items()} | {"broken": "{", "odd": changed("root.kind", "jump")}
    rows = ingest(in_memory(spark, docs))
    assert {r["trace_id"]: r["error_kind"] for r in errors_of(rows).collect()} == {"broken": "MalformedInput", "odd": "UnsupportedFeature"}
    assert rows.where("error_kind IS NULL").count() == len(CORPUS)
    (tmp_path / "a.json").write_text(CORPUS["destroyed"][0])
    assert ingest(read_files(spark, str(tmp_path))).first()["error_kind"] is None


def test_transfers_decode_only_in_full_shape(spark):
    good = [TRANSFER, topic(OTHER), topic(SENDER)]
    logs = [
        log(VICTIM, good, word(5), 0), log(VICTIM, [*good, word(1)], word(5), 1), log(VICTIM, good, "0x05", 2), log(VICTIM, good, word(1 << 128), 3),
        log(VICTIM, [TRANSFER, word(1 << 160), topic(SENDER)], word(5), 4), log(VICTIM, [word(1), *good[1:]], word(5), 5), log(VICTIM, good, word((1 << 128) - 1), 6),
    ]
    traces = traces_of(ingest(in_memory(spark, {"t": text(call("call", SENDER, VICTIM, logs=logs))})))
    found = to_relations(traces.withColumn("calls", traces.calls)).token_transfers.collect()
    assert [(t["id"], t["log_id"], t["from_addr"], t["to_addr"], t["amount_hex"]) for t in found] == [
        (0, 0, OTHER, SENDER, f"{5:032x}"), (1, 6, OTHER, SENDER, "f" * 32),
    ]


def test_hex_columns(spark):
    rows = spark.createDataFrame([("0x0f",), ("+ff",), ("0x" + "f" * 16,), ("0x1" + "0" * 16,), ("",), ("0X1",), ("zz",), (None,)], "x string")
    u64 = [r[0] for r in rows.select(hexcodec.u64(rows.x)).collect()]
    assert [None if x is None else int(x) for x in u64] == [15, 255, (1 << 64) - 1, None, None, None, None, None]
    wide = spark.createDataFrame([("0x" + "f" * 32,), ("0x1" + "0" * 32,), (hex(10**38 - 1),), (hex(10**38),)], "x string")
    got = wide.select(hexcodec.u128(wide.x).alias("u"), hexcodec.u128_decimal(hexcodec.u128(wide.x)).alias("d")).collect()
    assert [r["u"] for r in got] == ["f" * 32, None, f"{10**38 - 1:032x}", f"{10**38:032x}"]
    assert [None if r["d"] is None else int(r["d"]) for r in got] == [None, None, 10**38 - 1, None]
    parts = spark.createDataFrame([("AA" * 20, "0xA9059CBB00", "CallCode"), ("aa" * 19, "0x1234", "create2"), ("0x" + "aa" * 20, "0x123456789", "nope")], "a string, d string, k string")
    got = parts.select(hexcodec.address(parts.a), hexcodec.selector(parts.d), hexcodec.call_kind(parts.k), hexcodec.raw(parts.d)).collect()
    assert [tuple(r[:3]) for r in got] == [("0x" + "aa" * 20, "0xa9059cbb", "CallCode"), (None, None, "Create2"), ("0x" + "aa" * 20, None, None)]
    assert [None if r[3] is None else bytes(r[3]) for r in got] == [bytes.fromhex("A9059CBB00"), b"\x12\x34", None]


def test_call_tracer(spark):
    inner = {"type": "STATICCALL", "from": VICTIM, "to": OTHER, "gas": "0x5", "gasUsed": "0x4", "error": "execution reverted", "output": "0x"}
    frame = {"type": "CALL", "from": SENDER, "to": VICTIM, "value": "0x1", "gas": "0x10", "gasUsed": "0x8", "input": "0xa9059cbb", "calls": [inner]}
    got = convert(json.dumps({"jsonrpc": "2.0", "id": 1, "result": frame}), word(9), "0x2", "0x1")
    assert got["transaction"]["status"] == "success" and got["block"]["timestamp"] == "0x0" and got["root"]["calls"][0]["succeeded"] is False
    assert [c["value_hex"][-1] for c in flat(spark, {"t": json.dumps(got)})["t"]["calls"]] == ["1", "0"]
    with pytest.raises(IngestionError):
        convert(json.dumps(frame | {"type": "JUMP"}), word(9), "0x2", "0x1")
    with pytest.raises(IngestionError):
        convert("{}", word(9), "0x2", "0x1")
    docs = {word(9): frame, word(8): {"result": frame}, "odd": [], "kind": frame | {"type": "JUMP"}, "gas": frame | {"gas": 5}, "calls": frame | {"calls": {}}, "short": frame}
    given = [(k, json.dumps(d)) for k, d in docs.items()] + [(None, json.dumps(frame)), (None, None), ("none", None)]
    rows = ingest_call_tracer(spark.createDataFrame(given, "trace_id string, doc string")).collect()
    assert sorted((str(r["trace_id"]), r["error_kind"]) for r in rows if r["error_kind"]) == [
        ("None", "SourceUnavailable"), ("calls", "MalformedInput"), ("gas", "MalformedInput"), ("kind", "UnsupportedFeature"), ("none", "SourceUnavailable"), ("odd", "MalformedInput"),
    ]
    good = {r["trace_id"]: r for r in rows if not r["error_kind"]}
    assert set(good) == {word(9), word(8), "short", None} and good[None]["tx"]["tx_hash"] == word(0) and good[word(9)]["tx"]["tx_hash"] == word(9)
    assert all([(c["kind"], c["depth"], c["succeeded"], c["selector"]) for c in r["calls"]] == [("Call", 0, True, "0xa9059cbb"), ("StaticCall", 1, False, None)] for r in good.values())


def test_a_tracers_context_comes_by_hash(spark):
    frame = {"type": "CALL", "from": SENDER, "to": VICTIM, "gas": "0x10", "gasUsed": "0x8"}
    docs = in_memory(spark, {word(1): json.dumps(frame), word(2)[2:].upper(): json.dumps(frame), word(3): json.dumps(frame), "x": json.dumps(frame)})
    context = spark.createDataFrame(
        [(word(1), "0x5", "0x6", "0x7", "0x8"), (word(2), "0x9", None, "0x1", None), (word(2), "0xa", "0x1", "0x1", "0x1"), (word(3), "zz", "0x1", "0x1", "0x1"), (None, "0x1", "0x1", "0x1", "0x1"), ("x", "0x1", "0x1", "0x1", "0x1")],
        "tx_hash string, nonce string, block_number string, block_ts string, chain_id string",
    )
    got = {r["trace_id"]: r for r in ingest_call_tracer(docs, "0x20", "0x30", context).collect()}
    told = {k: r["tx"] and [int(r["tx"][c]) for c in ("nonce", "block_number", "block_ts", "chain_id")] for k, r in got.items()}
    assert told == {word(1): [5, 6, 7, 8], word(2)[2:].upper(): [9, 32, 1, 48], word(3): None, "x": [0, 32, 0, 48]}
    assert got[word(3)]["error_kind"] == "MalformedField"


def test_facts_by_key(spark):
    rows = traces_of(ingest(in_memory(spark, {n: CORPUS[n][0] for n in ("reentrancy", "price")})))
    r = to_relations(rows)
    keys = spark.createDataFrame([("reentrancy", 2), ("reentrancy", 2), ("reentrancy", 3), ("price", 0), (None, 0), ("x", 0)], "trace_id string, id int")
    assert sorted((x["trace_id"], x["call_id"], x["level"]) for x in to_relations(rows).lookup("calls", keys).collect()) == [("price", 0, 0), ("reentrancy", 2, 2)]
    assert [x["slot"] for x in r.fact("storage_changes", "price", 0).collect()] == [word(7)] and r.fact("logs", "price", 5).count() == 0


def test_a_trace_with_unsound_parents_has_no_facts(spark):
    """Parents that are not there, come later or go round, next to sound traces in one batch: nothing leaks and nothing hangs."""
    names = columns_of(CALL)

    def trace(parents):
        return [tuple({"call_id": i, "parent_id": p, "kind": "Call", "from_addr": "0x1", "to_addr": "0x2", "succeeded": True}.get(n) for n in names) for i, p in enumerate(parents)]

    given = {"good": [None, 0, 1], "missing": [None, 3], "circle": [None, 2, 1], "self": [None, 1], "below": [None, -2], "forward": [None, 2, 0], "last": [None, 0]}
    rows = spark.createDataFrame([(k, trace(p)) for k, p in given.items()], f"trace_id string, calls {array_type('calls')}").coalesce(1)
    got = {r["trace_id"]: r["calls"] and [c["reentrant"] for c in r["calls"]] for r in enrich_traces(rows).collect()}
    assert got == {k: None for k in given} | {"good": [False, True, True], "last": [False, True]}


def _plain_facts(calls):
    """reentrant, classes above and context of each call, walking up in a loop."""
    out = []
    for c in calls:
        above, up = [], c["parent_id"]
        while up is not None:
            above.append(calls[up])
            up = calls[up]["parent_id"]
        own = c
        while own["kind"] in ("DelegateCall", "CallCode") and own["parent_id"] is not None:
            own = calls[own["parent_id"]]
        parent_kind = above[0]["kind"] if above else None
        out.append((c["to_addr"] is not None and any(a["to_addr"] == c["to_addr"] for a in above), {a["kind"] for a in above}, parent_kind, own["to_addr"] or own["from_addr"]))
    return out


def test_facts_about_calls_above(spark):
    """Small and very large traces, rows without an id, repeated rows: each row keeps its place, and plain code gives the same."""
    rng, kinds = random.Random(4), ["Call", "DelegateCall", "CallCode", "Create", "StaticCall", "Selfdestruct"]

    def trace(n, parent):
        return [
            {"call_id": i, "parent_id": None if i == 0 else parent(i), "kind": "Call" if i == 0 else rng.choice(kinds), "from_addr": f"0x{rng.randint(0, 9)}", "to_addr": rng.choice([None, f"0x{rng.randint(0, n)}"])}
            for i in range(n)
        ]

    chain, wide, bush = trace(1000, lambda i: i - 1), trace(5000, lambda i: 0), trace(700, lambda i: rng.randrange(i))
    given = [(None, bush), (None, bush), ("chain", chain), ("wide", wide), ("small", bush[:9]), ("small", bush[:9]), ("empty", []), ("none", None)]
    slim = spark.createDataFrame(given, "trace_id string, calls array<struct<call_id: int, parent_id: int, kind: string, from_addr: string, to_addr: string>>")
    whole = slim.select("trace_id", slim.calls.cast("array<struct<call_id: int, parent_id: int, kind: string, from_addr: string, to_addr: string>>").alias("calls"))
    rest = ("depth", "value_hex", "gas_limit", "gas_used", "succeeded", "selector")
    padded = whole.withColumn("calls", F.transform("calls", lambda c: F.struct(*(c[x] if x not in rest else F.lit(None).alias(x) for x in columns_of(CALL)))))
    got = enrich_traces(padded).collect()
    assert sorted(str(r["trace_id"]) for r in got) == sorted(str(t) for t, _ in given)
    wanted = {t: c and _plain_facts(c) for t, c in given}
    names = {1 << i: k for i, k in enumerate(dict.fromkeys(KIND_CLASSES.values()))}
    for r in got:
        if r["calls"] is None:
            assert wanted[r["trace_id"]] is None
            continue
        found = [(c["reentrant"], {n for b, n in names.items() if c["above"] & b}, c["parent_kind"], c["context"]) for c in r["calls"]]
        assert found == [(a, {KIND_CLASSES[k] for k in above}, up, ctx) for a, above, up, ctx in wanted[r["trace_id"]] or []]


def test_half_a_surrogate_pair_is_one_bad_document(spark):
    """An escape that no UTF-8 text can hold spoils its own document only."""
    whole = text(ROOT)
    bad = {"status": whole.replace('"success"', r'"\ud800"'), "kind": whole.replace('"kind": "call"', r'"kind": "\udfff"'), "field": whole.replace('"block"', r'"\ud800"'), "good": whole}
    got = {r["trace_id"]: (r["error_kind"], r["error"]) for r in ingest(in_memory(spark, bad)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"status": "MalformedField", "kind": "UnsupportedFeature", "field": "MalformedInput", "good": None}
    assert "?" in got["status"][1]


def test_sources(spark, tmp_path):
    """A missing path is an unavailable source; any class with documents() is one."""
    with pytest.raises(IngestionError, match="SourceUnavailable"):
        ingest_from(spark, Files(str(tmp_path / "nothing")))
    (tmp_path / "a.json").write_text(text(ROOT))

    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "b.json").write_bytes(text(ROOT).encode().replace(b'"success"', b'"succ\xffss"'))
    assert [r["error_kind"] for r in ingest_from(spark, Files(str(tmp_path / "bytes"))).collect()] == ["MalformedInput"]

    class Twice:
        def documents(self, spark):
            rows = Files(str(tmp_path)).documents(spark)
            return rows.unionAll(rows)

    assert [r["error_kind"] for r in ingest_from(spark, Twice()).collect()] == [None, None]
