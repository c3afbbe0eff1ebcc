"""Documents checked as a whole have the rows that the checks one by one give, and usual ones need no others."""

import json

from pyspark.sql import functions as F
from test_schema_reading import bare, rows_both_ways
from traces import OTHER, SENDER, VICTIM, call, document, log, word, write

from tracewright.sources import documents, lens
from tracewright.sources.documents import in_memory, ingest

TREE = call(
    "call", SENDER, VICTIM, call("delegatecall", VICTIM, OTHER, call("staticcall", OTHER, SENDER), writes=[write(VICTIM), write(VICTIM)], logs=[log(VICTIM, [word(1)], "0x00", 1)]),
    call("call", VICTIM, OTHER, writes=[write(OTHER)], logs=[log(OTHER, [], "0x", 2), log(OTHER, [word(1), word(2), word(3), word(4)], "0xAB", 3)]), data="0xA9059CBB00",
)


def odd_values() -> dict[str, str]:
    def plain(root):
        doc = document(root)
        del doc["block"]["baseFee"]
        return json.dumps(doc)

    tree = plain(TREE)
    second = tree.index('"delegatecall"')
    later = lambda old, new: tree[:second] + tree[second:].replace(old, new, 1)
    nested = lambda *logs, writes=(): plain(call("call", SENDER, VICTIM, call("call", VICTIM, OTHER, writes=list(writes), logs=list(logs)), logs=[log(VICTIM, [], "0x", 7)]))
    return {
        "tree": tree, "compact": json.dumps(json.loads(tree), separators=(",", ":")), "indented": json.dumps(json.loads(tree), indent=3), "upper": tree.replace(VICTIM, "0x" + VICTIM[2:].upper()),
        "bare_hex": later(VICTIM, VICTIM[2:]), "blank_from": later(f'"from": "{VICTIM}"', '"from": ""'), "blank_to": later(f'"to": "{OTHER}"', '"to": ""'), "blank_kind": tree.replace('"staticcall"', '""'),
        "two_in_one": later(f'"from": "{VICTIM}"', f'"from": "{VICTIM}{VICTIM}"'), "gap": later(f'"from": "{VICTIM}"', f'"from": "{VICTIM}\\u0001{VICTIM}"'),
        "gaps": later(f'"from": "{VICTIM}"', f'"from": "{VICTIM}{chr(92)}u0001' + "\\u0001" * 9 + f'{VICTIM}"'), "spaced_value": later(VICTIM, VICTIM[:-1] + " "), "escaped": later("0x", "\\u0030x"),
        "capital": tree.replace('"staticcall"', '"STATICCALL"'), "unknown": tree.replace('"staticcall"', '"jump"'), "root_borrows": plain(call("delegatecall", SENDER, VICTIM)), "no_to": later(f'"to": "{OTHER}", ', ""),
        "five_topics": nested(log(OTHER, [word(i) for i in range(5)], "0x", 8)), "wide_index": nested(log(OTHER, [], "0x", 1 << 33)), "odd_data": nested(log(OTHER, [], "0xabc", 8)), "again": nested(log(OTHER, [], "0x", 7)),
        "blank_topic": nested(log(OTHER, [word(1)], "0x", 8)).replace(word(1), ""), "foreign_first": nested(log(OTHER, [], "0x", 7), writes=[write(VICTIM)]), "foreign": nested(writes=[write(OTHER), write(SENDER)]),
        "number_and_more": later('"gasUsed": "', '"gasUsed": 1, "x": "'), "list_and_after": later(f'"from": "{VICTIM}"', f'"from": ["{VICTIM}"]') + "x}", "number_kind": later('"delegatecall"', "12"), "null_kind": later('"delegatecall"', "null"),
        "null_word": tree.replace('"status": "success"', '"status": null'), "bad_status": tree.replace('"success"', '"done"'), "bad_nonce": tree.replace('"nonce": "0x1"', '"nonce": "0xzz"'), "no_block": json.dumps({k: v for k, v in bare().items() if k != "block"}),
    }


def test_odd_values_both_ways(spark, monkeypatch):
    docs = in_memory(spark, odd_values())
    read, unfolded = rows_both_ways(monkeypatch, documents, lambda: ingest(docs))
    assert read == unfolded


def test_usual_documents_are_checked_as_a_whole(spark, monkeypatch):
    """Neither are marks counted for them nor frames checked one by one; an index that comes twice or a foreign change is found all the same."""
    monkeypatch.setattr(documents, "_frame_error", lambda *_: F.raise_error("a frame was checked").cast(documents.ERROR))
    monkeypatch.setattr(documents, "_holds", lambda _: F.raise_error("marks were counted").cast(documents.HELD))
    rows = lens.raw_traces(spark, "/root/testdata/sf0.001").limit(50)
    assert ingest(lens.nested_documents(rows)).where("error_kind IS NULL").count() == 50
    odd = odd_values()
    found = {r["trace_id"]: r["error_kind"] for r in ingest(in_memory(spark, {k: odd[k] for k in ("tree", "compact", "indented", "again", "foreign_first")})).collect()}
    assert found == {"tree": None, "compact": None, "indented": None, "again": "DuplicateLogIndex", "foreign_first": "InvalidStorageOwnership"}
