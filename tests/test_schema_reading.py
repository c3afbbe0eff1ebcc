"""Documents read by a schema and by variants give the same rows."""

import json

from pyspark.sql import functions as F
from traces import CORPUS, OTHER, SENDER, VICTIM, call, document, log, word, write

from tracewright.sources import calltracer, documents, lens
from tracewright.sources.calltracer import ingest_call_tracer
from tracewright.sources.documents import in_memory, ingest

ROOT = call("call", SENDER, VICTIM, call("delegatecall", VICTIM, OTHER, writes=[write(VICTIM)]), writes=[write(VICTIM)], logs=[log(VICTIM, [word(1), word(2)], "0x00", 3)], data="0xa9059cbb")


def bare():
    """A document without nulls."""
    doc = document(ROOT)
    del doc["block"]["baseFee"]
    return doc


def odd_documents() -> dict[str, str]:
    plain = json.dumps(bare())
    chain = call("call", SENDER, VICTIM)
    for _ in range(documents.LEVELS + 1):
        chain = call("call", SENDER, VICTIM, chain)
    out = {
        "plain": plain, "spaced": "\n " + json.dumps(bare(), indent=2) + "\t", "null": json.dumps(document(ROOT)), "deep": json.dumps(document(chain)),
        "number": plain.replace('"gasUsed": "0x5208"', '"gasUsed": 5208'), "balanced": plain.replace('"nonce": "0x1"', '"nonce": 1').replace('"success"', r'"\"\""'),
        "flag": plain.replace("true", '"true"', 1), "twice": plain.replace('"status"', '"status": "success", "status"'), "single": plain.replace('"success"', "'success'"),
        "single_balanced": plain.replace('"success"', "'suc\"ce\"ss'"), "after": plain + " {}", "closed": plain + "}", "list": plain + "], [{}", "comma": plain + ",",
        "colon": plain.replace('"success"', '"a:b"'), "brace": plain.replace('"success"', '"{"'), "named": plain.replace('"status"', r'"status"'), "half": plain.replace('"success"', r'"\ud800"'),
        "null_topic": plain.replace(f'"{word(1)}", "{word(2)}"', f'"{word(1)}", null'), "list_topic": plain.replace(f'"{word(2)}"]', '["0x2"]]'), "number_topic": plain.replace(f'"{word(2)}"]', "2]"),
        "null_call": plain.replace('"calls": []', '"calls": [null]'), "one_call": plain.replace('"calls": []', '"calls": {}'), "more": plain.replace('"block":', '"more": "x", "block":'), "mark": "﻿" + plain,
        "missing": plain.replace('"nonce": "0x1", ', ""), "cut": plain[:-1], "kind": plain.replace('"kind": "call"', '"kind": "jump"'), "object": plain.replace('"success"', '{"a": "b"}'), "comment": plain.replace("{", "{/* */", 1),
    }
    return out | {name: doc for name, (doc, _) in CORPUS.items()}


def rows_both_ways(monkeypatch, module, ingested):
    def rows(df):
        return sorted(repr(r) for r in df.collect())

    read = rows(ingested())
    monkeypatch.setattr(module, "all_read", lambda *_: F.lit(False))
    return read, rows(ingested())


def test_documents_both_ways(spark, monkeypatch):
    docs = in_memory(spark, odd_documents())
    read, unfolded = rows_both_ways(monkeypatch, documents, lambda: ingest(docs))
    assert read == unfolded


def test_tracer_output_both_ways(spark, monkeypatch):
    inner = {"type": "STATICCALL", "from": VICTIM, "to": OTHER, "gas": "0x5", "gasUsed": "0x4", "error": "execution reverted", "output": "0x"}
    frame = {"type": "CALL", "from": SENDER, "to": VICTIM, "value": "", "gas": "0x10", "gasUsed": "0x8", "input": "0xa9059cbb", "calls": [inner]}
    reply = {"jsonrpc": "2.0", "id": 1, "result": frame}
    given = [
        frame, reply, reply | {"id": "1"}, reply | {"error": {"code": 1}}, frame | {"error": None}, frame | {"error": 5}, frame | {"gas": 5}, frame | {"calls": None}, frame | {"calls": [None]},
        frame | {"logs": []}, frame | {"to": None}, frame | {"to": 5}, reply | {"result": None}, reply | frame, {"result": []}, {}, frame | {"result": frame}, frame | {"type": "JUMP"}, frame | {"revertReason": "a:b"},
    ]
    texts = [json.dumps(x) for x in given] + [json.dumps(reply) + tail for tail in ("}", " {}", "]", "x")] + [json.dumps(frame) + '}, {"a": {}', json.dumps(frame)[:-1]]
    docs = in_memory(spark, {word(i): x for i, x in enumerate(texts)})
    read, unfolded = rows_both_ways(monkeypatch, calltracer, lambda: ingest_call_tracer(docs))
    assert read == unfolded


def test_usual_documents_take_the_schema(spark, monkeypatch):
    """The variants of documents without oddities are never made."""
    monkeypatch.setattr(documents, "parse", lambda _: F.raise_error("a variant was made").cast("variant"))
    rows = lens.raw_traces(spark, "/root/testdata/sf0.001").limit(50)
    assert ingest(lens.nested_documents(rows)).where("error_kind IS NULL").count() == 50
    assert ingest(in_memory(spark, {"t": json.dumps(bare())})).first()["error_kind"] is None
