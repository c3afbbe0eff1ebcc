"""Trace documents (JSON text) to trace rows, in columns.

A document is a tree of call frames. It is parsed to a variant and unfolded level by level inside
its row: the frames of a level are read, their children are the next level, each with its path.
Sorted by path, frames stand in the order in which a walk through the tree visits them; one fold in
that order gives parents, storage contexts and ids. Checks are columns, too: the first that fails, in
the document's order, is the row's error.

Most documents need no variant: they are read by a schema, in one pass, where the fields read account
for every mark of the text (see all_read). All others take the way above; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexcodec import KIND_CLASSES, address, byte_digits, call_kind, selector, topic_address, u64, u128, word
from ..model import CALL, LOG, STORAGE, TX, array_type, columns_of, struct_type
from ..operators.enrich import BORROWED, enrich_traces

MAX_DEPTH = 1024
# Fixed value: the signature hash of Transfer(address,address,uint256).
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
ERROR = "struct<kind: string, detail: string>"

# Fields of each object: their type, with ? where they may be missing; nullable ones may be null as well.
OBJECTS = {
    "document": {"transaction": "object", "block": "object", "root": "object"},
    "transaction": {"hash": "text", "from": "text", "to": "text?", "value": "text", "nonce": "text", "gasUsed": "text", "status": "text"},
    "block": {"number": "text", "timestamp": "text", "chainId": "text", "baseFee": "text?"},
    "call": {
        "kind": "text", "from": "text", "to": "text?", "value": "text", "gasLimit": "text", "gasUsed": "text", "succeeded": "flag", "input": "text?",
        "storageChanges": "list?", "logs": "list?", "calls": "list?",
    },
    "storage change": {"contract": "text", "slot": "text", "before": "text", "after": "text"},
    "log": {"address": "text", "topics": "list", "data": "text", "logIndex": "text"},
}
NULLABLE = ("to", "baseFee", "input")


class IngestionError(ValueError):
    """kind: SourceUnavailable, MalformedInput, MalformedField, UnsupportedFeature,
    InvalidStorageOwnership, DuplicateLogIndex or ArenaConstruction."""

    def __init__(self, kind: str, detail: str):
        self.kind, self.detail = kind, detail
        super().__init__(f"{kind}: {detail}")


# ------------------------------------------------------------------ variants


def parse(text: Column) -> Column:
    """A text that is one JSON object, as a variant; else null. Fields that come twice are no JSON here, nor are bytes that are no UTF-8.

    The parser stops after the first value; so the text is parsed inside a list and inside an object,
    and what follows a value can be right in one of them only.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    nested = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = F.get(listed, F.lit(0))
    return F.when(F.is_valid_utf8(text) & (F.size(listed) == 1) & nested.isNotNull() & fields(one).isNotNull(), one)


def fields(x: Column) -> Column:
    """The names of an object's fields; null if it is none."""
    return F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))


def part(x: Column, name: str) -> Column:
    return F.try_variant_get(x, f"$.{name}", "variant")


def text_of(x: Column, name: str) -> Column:
    """A field's text; null if it is missing or no text."""
    return F.when(F.schema_of_variant(part(x, name)) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))


def list_of(x: Column, name: str) -> Column:
    return F.try_variant_get(x, f"$.{name}", "array<variant>")


def _of_type(x: Column, name: str, kind: str) -> Column:
    if kind == "list":
        return list_of(x, name).isNotNull()
    if kind == "object":
        return fields(part(x, name)).isNotNull()
    return F.schema_of_variant(part(x, name)) == {"text": "STRING", "flag": "BOOLEAN"}[kind]


def misshapen(x: Column, what: str) -> Column:
    """What is wrong with an object's fields; null if nothing is."""
    spec, names = OBJECTS[what], fields(x)
    needed = [n for n, kind in spec.items() if not kind.endswith("?")]
    unknown = F.get(F.array_sort(F.array_except(names, F.array(*map(F.lit, spec)))), F.lit(0))
    missing = F.get(F.array_sort(F.array_except(F.array(*map(F.lit, needed)), names)), F.lit(0))
    wrong = []
    for n, kind in spec.items():
        fits = _of_type(x, n, kind.rstrip("?"))
        if n in NULLABLE:
            fits = fits | (F.schema_of_variant(part(x, n)) == "VOID")
        if kind.endswith("?"):
            fits = fits | part(x, n).isNull()
        wrong.append(F.when(~F.coalesce(fits, F.lit(False)), f"field `{n}` of a {what} has the wrong type"))
    return F.coalesce(
        F.when(names.isNull(), f"a {what} must be an object"),
        F.concat(F.lit("unknown field `"), unknown, F.lit(f"` in a {what}")),
        F.concat(F.lit("missing field `"), missing, F.lit(f"` in a {what}")),
        *wrong,
    )


def first_of(found: Column) -> Column:
    """The first element that is not null."""
    return F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))


# ------------------------------------------------------------------ frames as they are written

CHANGE_TEXTS, LOG_TEXTS = ("contract", "slot", "before", "after"), ("address", "data", "logIndex")
WRITTEN = (
    "kind string, from string, to string, value string, gasLimit string, gasUsed string, succeeded boolean, input string, "
    "changes array<struct<contract: string, slot: string, before: string, after: string>>, "
    "logs array<struct<topics: array<string>, address: string, data: string, logIndex: string>>, malformed string"
)
_LEVEL = "array<struct<path: array<int>, frame: variant>>"
FRAMES = f"array<{struct_type('path array<int>, ' + WRITTEN)}>"


def document_frame(x: Column) -> list[Column]:
    """The columns of WRITTEN for a document's frame."""

    def texts(y: Column, names) -> list[Column]:
        return [text_of(y, n).alias(n) for n in names]

    topics = lambda y: F.transform(list_of(y, "topics"), lambda t: F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string")))
    changes, logs = list_of(x, "storageChanges"), list_of(x, "logs")
    inside = lambda y: F.coalesce(misshapen(y, "log"), F.when(F.exists(topics(y), lambda t: t.isNull()), "topics must be strings"))
    return [
        *texts(x, ("kind", "from", "to", "value", "gasLimit", "gasUsed")), F.try_variant_get(x, "$.succeeded", "boolean").alias("succeeded"), text_of(x, "input").alias("input"),
        F.transform(changes, lambda y: F.struct(*texts(y, CHANGE_TEXTS))).alias("changes"),
        F.transform(logs, lambda y: F.struct(topics(y).alias("topics"), *texts(y, LOG_TEXTS))).alias("logs"),
        F.coalesce(misshapen(x, "call"), first_of(F.transform(changes, lambda y: misshapen(y, "storage change"))), first_of(F.transform(logs, inside))).alias("malformed"),
    ]


def unfolded(root: Column, text: Column, frame: Callable[[Column], list[Column]]) -> Column:
    """All frames below a root, in visiting order: path and WRITTEN. No level is without a bracket in the text."""

    def read(level: Column) -> Column:
        return F.transform(level, lambda x: F.struct(x["path"].alias("path"), *frame(x["frame"])))

    def below(level: Column) -> Column:
        def children(x: Column) -> Column:
            own = F.coalesce(list_of(x["frame"], "calls"), F.array().cast("array<variant>"))
            return F.transform(own, lambda c, i: F.struct(F.array_append(x["path"], i).alias("path"), c.alias("frame")))

        return F.flatten(F.transform(level, children))

    start = F.struct(F.array().cast(FRAMES).alias("done"), F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("frame"))).cast(_LEVEL).alias("next"))
    step = lambda at: F.struct(F.concat(at["done"], read(at["next"])).cast(FRAMES).alias("done"), below(at["next"]).cast(_LEVEL).alias("next"))
    levels = F.sequence(F.lit(0), F.least(F.lit(MAX_DEPTH + 1), F.regexp_count(text, F.lit(r"\["))))
    return F.aggregate(levels, start, lambda at, _: F.when(F.size(at["next"]) == 0, at).otherwise(step(at)), lambda at: F.array_sort(at["done"]))


# ------------------------------------------------------------------ frames read by a schema

LEVELS, SHORT = 10, 1 << 20  # calls above each other, bytes of text; what has more takes the other way
READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"}
HELD = "struct<members: int, strings: int, objects: int, arrays: int>"


def frame_type(own: str) -> str:
    """A frame of these fields with LEVELS levels of calls below it."""
    kind = f"struct<{own}>"
    for _ in range(LEVELS):
        kind = f"struct<{own}, calls: array<{kind}>>"
    return kind


def present(*cs: Column) -> Column:
    """How many are not null."""
    return sum((c.isNotNull().cast("int") for c in cs), F.lit(0))


def held(members: Column, strings: Column, objects: Column, arrays: Column) -> Column:
    return F.struct(members.alias("members"), strings.alias("strings"), objects.alias("objects"), arrays.alias("arrays")).cast(HELD)


def in_order(root: Column, names: list[str]) -> Column:
    """All frames of a root of frame_type, in visiting order: path, these of their fields, whether they list calls, and how many.
    Each level is written out in the plan, so what is said about a frame is said afterwards, about the list."""

    def walk(x: Column, path: Column, left: int) -> Column:
        lists, calls = (x["calls"].isNotNull(), F.size(x["calls"])) if left else (F.lit(False), F.lit(None).cast("int"))
        own = F.array(F.struct(path.alias("path"), *(x[n].alias(n) for n in names), lists.alias("lists"), calls.alias("n_calls")))
        if not left:
            return own
        below = F.flatten(F.transform(x["calls"], lambda c, i: walk(c, F.array_append(path, i), left - 1)))
        return F.when(x["calls"].isNull(), own).otherwise(F.concat(own, below))

    return walk(root, F.array().cast("array<int>"), LEVELS)


def all_read(text: Column, read: Column, holds: Callable[[Column], Column], around: Column, quick: Column | None = None) -> Column:
    """Is a text one JSON object of which nothing is left out, or taken for another type?

    quick: a sign that it is one, so that marks need no counting; read: its frames; holds: how many members, strings, objects and lists a frame has (null if something is missing); around:
    those outside of frames. Where no quote is escaped, all quotes are those of names and strings; marks inside of strings can only
    make the text's count the larger one. So if the counts are equal, each member (or double) was read, each text is a string,
    each object and list is known; and with all braces in the first value and one at the end, nothing follows it.
    """
    add = lambda a, b: F.struct(*((a[k] + b[k]).alias(k) for k in ("members", "strings", "objects", "arrays"))).cast(HELD)
    total = F.aggregate(F.transform(read, holds), around, lambda a, x: F.when(a.isNotNull() & x.isNotNull(), add(a, x)))
    marks = lambda mark: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))
    bare = F.btrim(text, F.lit(" \t\r\n"))

    def equal(n: Column) -> Column:
        return (
            (marks(":") == n["members"]) & (marks('"') == 2 * (n["members"] + n["strings"])) & (marks("{") == n["objects"])
            & (marks("}") == n["objects"]) & (marks("[") == n["arrays"])
        )

    plain = (F.octet_length(text) <= SHORT) & F.is_valid_utf8(text) & bare.startswith("{") & bare.endswith("}") & ~text.contains('\\"')
    counted = F.coalesce(plain & F.exists(F.array(total), equal), F.lit(False))
    return counted if quick is None else F.when(quick, F.lit(True)).otherwise(counted)


_SCALARS = [n for n, kind in OBJECTS["call"].items() if kind.startswith("text")]
_FIELDS = [n for n in OBJECTS["call"] if n != "calls"]
_texts = lambda what: ", ".join(f"`{n}`: string" for n, kind in OBJECTS[what].items() if kind.startswith("text"))
_DOCUMENT = (
    f"struct<transaction: struct<{_texts('transaction')}>, block: struct<{_texts('block')}>, root: "
    + frame_type(f"{_texts('call')}, succeeded: boolean, storageChanges: array<struct<{_texts('storage change')}>>, logs: array<struct<topics: array<string>, {_texts('log')}>>")
    + ", bad: string>"
)


def _needed(x: Column, what: str) -> Column:
    """Has an object all it needs?"""
    out = x.isNotNull()
    for n, kind in OBJECTS[what].items():
        out = out if kind.endswith("?") else out & x[n].isNotNull()
    return out


def _holds(x: Column) -> Column:
    """What a frame of _DOCUMENT holds; null if it lacks what it needs."""
    changes, logs = x["storageChanges"], x["logs"]
    n_changes, n_logs = F.greatest(F.lit(0), F.size(changes)), F.greatest(F.lit(0), F.size(logs))
    n_topics = F.when(n_logs == 0, 0).otherwise(F.aggregate(logs, F.lit(0), lambda n, y: n + F.size(y["topics"])))
    texts, lists = present(*(x[n] for n in _SCALARS)), present(changes, logs) + x["lists"].cast("int")
    whole = (
        _needed(x, "call") & F.coalesce(F.forall(changes, lambda y: _needed(y, "storage change")), F.lit(True))
        & F.coalesce(F.forall(logs, lambda y: _needed(y, "log") & F.forall(y["topics"], lambda t: t.isNotNull())), F.lit(True))
    )
    return F.when(whole, held(texts + 1 + lists + 4 * (n_changes + n_logs), texts + 4 * n_changes + 3 * n_logs + n_topics, 1 + n_changes + n_logs, lists + n_logs))


def _written(x: Column) -> list[Column]:
    """The columns of WRITTEN for a frame of _DOCUMENT."""
    from_ = {"changes": x["storageChanges"], "malformed": F.lit(None).cast("string")}
    return [(from_[n] if n in from_ else x[n]).alias(n) for n in columns_of(WRITTEN)]


def written(read: Column, frame: Callable[[Column], list[Column]]) -> Column:
    return F.transform(read, lambda x: F.struct(x["path"].alias("path"), *frame(x))).cast(FRAMES)


# ------------------------------------------------------------------ usual documents, checked as a whole

# Stands between values. In a text it is written in six bytes, so no value that holds it passes for one of its length.
_GAP = "\x01"
_SURE = r"(?:0x|[a-eghj-mo-su-zA-HJ-MO-Z])[!-~&&[^!\x22\x5c]]*+"  # is no number, flag, list or object that was read as a text
_HEX = "[0-9a-fA-F]"
_EXACT = {
    "address": f"0x{_HEX}{{40}}", "word": f"0x{_HEX}{{64}}", "amount": f"0x{_HEX}{{1,32}}", "count": f"0x{_HEX}{{1,16}}", "index": f"0x{_HEX}{{1,8}}",
    "bytes": f"0x(?:{_HEX}{{2}})*+", "kind": f"(?i:{'|'.join(sorted(KIND_CLASSES, key=len, reverse=True))})",
}
# The texts of frames, of storage changes and of logs, with what they have to be.
_VALUES = {
    "call": {"kind": "kind", "from": "address", "to": "address", "value": "amount", "gasLimit": "count", "gasUsed": "count", "input": "bytes"},
    "storage change": {"contract": "address", "slot": "word", "before": "word", "after": "word"},
    "log": {"address": "address", "data": "bytes", "logIndex": "index"},
}


def _all(joined: Column, one: str) -> Column:
    """Is each of the joined texts of this form?"""
    return joined.rlike(rf"^(?:{one}(?:\x01++|\z))*+\z")


def _less_empty(lists: Column, name: str, inside: Column) -> Column:
    """The bytes of lists of this name and of the commas between what they hold."""
    return F.size(F.filter(lists, lambda x: x.isNotNull())) * (len(name) + 6) - F.size(F.filter(lists, lambda x: F.size(x) > 0)) + inside


def with_checks(rows: DataFrame) -> DataFrame:
    """Rows of doc, t and read with: quick (the text holds what was read and nothing else) and exact (all texts of its frames are valid).

    A text has at least the bytes of all that was read of it: names, values, their marks. If it has no more (white space apart),
    nothing was left out; which holds where each text that was read must have been a string. Fields are looked at for all frames
    at once, joined to one text by gaps as long as the marks and the name of one value.
    """
    read, t = F.col("read"), F.col("t")
    flat = {"call": read}
    for what, name in (("storage change", "storageChanges"), ("log", "logs")):
        flat[what] = F.flatten(F.filter(read[name], lambda a: a.isNotNull()))
    rows = rows.withColumns({f"_{what}": own for what, own in flat.items() if what != "call"})
    flat = {what: read if what == "call" else F.col(f"_{what}") for what in flat}
    joined, marks, kinds, blank = {}, {}, {}, F.lit(False)
    for what, values in _VALUES.items():
        for n, kind in values.items():
            gap = _GAP * (len(n) + 6)
            own = flat[what][n]
            joined[f"_{what} {n}"] = F.concat_ws(gap, own) if OBJECTS[what][n].endswith("?") else F.array_join(own, gap, "!")
            marks[f"_{what} {n}"], kinds[f"_{what} {n}"] = len(n) + 6, kind
            if kind != "bytes":
                blank = blank | F.coalesce(F.array_contains(own, ""), F.lit(False))
    topics = flat["log"]["topics"]
    blank = blank | F.coalesce(F.array_contains(F.flatten(topics), ""), F.lit(False)) | F.coalesce(F.exists(topics, lambda x: F.size(x) > 4), F.lit(False))
    joined["_topics"], marks["_topics"], kinds["_topics"] = F.array_join(F.flatten(topics), _GAP * 2, "!"), 2, "word"
    joined["_succeeded"], marks["_succeeded"] = F.array_join(read["succeeded"].cast("array<string>"), _GAP * 13, "!"), 13
    joined["_outer"] = F.concat_ws(_GAP, *(t[what][n] for what in ("transaction", "block") for n in OBJECTS[what]))
    rows = rows.withColumns(joined)

    col = lambda n: F.col(f"`{n}`")
    strings = sum((F.octet_length(col(n)) + F.when(F.octet_length(col(n)) > 0, m).otherwise(0) for n, m in marks.items()), F.lit(0))
    outer = sum((F.coalesce(F.octet_length(t[what][n]) + len(n) + 6, F.lit(0)) for what in ("transaction", "block") for n in OBJECTS[what]), F.lit(0))
    lists = _less_empty(read["storageChanges"], "storageChanges", F.size(flat["storage change"])) + _less_empty(read["logs"], "logs", F.size(flat["log"]))
    calls = read["n_calls"]
    lists += F.size(F.filter(calls, lambda n: n.isNotNull())) * (len("calls") + 6) - F.size(F.filter(calls, lambda n: n > 0)) + F.size(read) - 1
    lists += _less_empty(topics, "topics", F.size(F.flatten(topics)))
    objects = F.size(read) + F.size(flat["storage change"]) + F.size(flat["log"]) + sum(len(n) + 4 for n in OBJECTS["document"]) + 3
    wanted = strings + outer + lists + objects

    of_kind = {kind: [col(n) for n, k in kinds.items() if k == kind] for kind in _EXACT}
    together = {kind: F.concat_ws(_GAP, *(F.nullif(c, F.lit("")) for c in own)) for kind, own in of_kind.items()}
    rows = rows.select("trace_id", "doc", "t", "read", col("_outer"), col("_succeeded"), wanted.alias("_wanted"), blank.alias("_blank"), *(c.alias(f"_all {k}") for k, c in together.items()))
    exact = ~F.col("_blank")
    for kind, form in _EXACT.items():
        exact = exact & _all(col(f"_all {kind}"), form)
    rows = rows.withColumn("exact", F.coalesce(exact, F.lit(False)))
    sure = _all(col("_outer"), _SURE) & ~col("_succeeded").contains("!") & (F.col("exact") | _all(F.concat_ws(_GAP, *(F.nullif(col(f"_all {k}"), F.lit("")) for k in _EXACT)), _SURE))
    size = F.octet_length("doc")
    whole = (size == F.col("_wanted")) | ((size > F.col("_wanted")) & (F.octet_length(F.regexp_replace("doc", r"[ \t\r\n]+", "")) == F.col("_wanted")))
    needed = _needed(t["transaction"], "transaction") & _needed(t["block"], "block")
    quick = F.coalesce((size <= SHORT) & needed & sure & whole, F.lit(False))
    return rows.select("trace_id", "doc", "t", "read", "exact", quick.alias("quick"))


def with_made(rows: DataFrame, **made: Column) -> DataFrame:
    """Rows with more columns, each made once. As generated columns they are not written out again in
    every expression, or pushed filter, that names them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


# ------------------------------------------------------------------ facts and errors of a row

_PLACE = "struct<parent: int, context: string, changes: int, logs: int>"
_ABOVE = "array<struct<id: int, context: string>>"


def placed(frames: Column) -> Column:
    """For each frame, in visiting order: its parent, its storage context (none for a root that borrows code), and the
    changes and logs before it. The frames above the one at hand are kept as a stack."""

    def step(at: Column, f: Column) -> Column:
        me, depth = F.size(at["out"]), F.size(f["path"])
        up = F.get(at["above"], depth - 1)
        borrowed = F.coalesce(call_kind(f["kind"]).isin(*BORROWED), F.lit(False))
        context = F.when(borrowed, up["context"]).otherwise(F.coalesce(address(f["to"]), address(f["from"])))
        place = F.struct(up["id"].alias("parent"), context.alias("context"), at["changes"].alias("changes"), at["logs"].alias("logs"))
        n = lambda name: (at[name] + F.greatest(F.lit(0), F.size(f[name]))).cast("int").alias(name)
        above = F.array_append(F.slice(at["above"], F.lit(1), depth), F.struct(me.alias("id"), context.alias("context")))
        return F.struct(above.cast(_ABOVE).alias("above"), n("changes"), n("logs"), F.array_append(at["out"], place.cast(_PLACE)).alias("out"))

    start = F.struct(F.array().cast(_ABOVE).alias("above"), F.lit(0).alias("changes"), F.lit(0).alias("logs"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    return F.aggregate(frames, start, step, lambda at: at["out"])


def error(kind: str, *detail: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.concat(*(F.lit(d) if isinstance(d, str) else F.coalesce(d, F.lit("")) for d in detail)).alias("detail"))


def _field(name: str, given: Column, value: Column, why: str) -> Column:
    """The error of a field that is there but could not be read."""
    return F.when(given.isNotNull() & value.isNull(), error("MalformedField", f"field `{name}` has an invalid value `", given, f"`: {why}"))


_U64, _U128, _ADDRESS, _WORD, _BYTES = (
    (u64, "no hex number of 64 bits"), (u128, "no hex number of 128 bits"), (address, "no 20 bytes of hex"), (word, "no 32 bytes of hex"), (byte_digits, "no whole bytes of hex"),
)


def _status(c: Column) -> Column:
    return F.when(c == "success", "Success").when(c == "reverted", "Reverted")


# How each field of a transaction is read: its name in TX and in a document.
_TX = {
    "tx_hash": ("transaction.hash", _WORD), "from_addr": ("transaction.from", _ADDRESS), "to_addr": ("transaction.to", _ADDRESS), "value_hex": ("transaction.value", _U128),
    "nonce": ("transaction.nonce", _U64), "gas_used": ("transaction.gasUsed", _U64), "status": ("transaction.status", (_status, "neither success nor reverted")),
    "block_number": ("block.number", _U64), "block_ts": ("block.timestamp", _U64), "chain_id": ("block.chainId", _U64), "base_fee_hex": ("block.baseFee", _U128),
}
# A call's fields in CALL, in the order in which they are checked: the name in a document, and how they are read.
_CALL = {
    "from_addr": ("from", _ADDRESS), "to_addr": ("to", _ADDRESS), "value_hex": ("value", _U128), "gas_limit": ("gasLimit", _U64), "gas_used": ("gasUsed", _U64),
    "selector": ("input", (byte_digits, _BYTES[1])),
}


def _change_error(given: Column, s: Column, path: Column, context: Column) -> Column:
    own = F.when(s["contract"] != context, error("InvalidStorageOwnership", "the call at ", path, " declares ", s["contract"], "; its storage context is ", context))
    contract = _field("storageChange.contract", given["contract"], s["contract"], _ADDRESS[1])
    return F.coalesce(contract, own, *(_field(f"storageChange.{k}", given[k], s[k], _WORD[1]) for k in ("slot", "before", "after")))


def _log_error(given: Column, x: Column, indexes: Column, many: Column) -> Column:
    """indexes: of all of the trace's logs, looked through only where some come twice."""
    index = x["log_index"]
    again = F.when(many, F.array_position(indexes, index) <= x["id"])
    topic = F.get(given["topics"], F.array_position(F.transform(x["topics"], lambda t: t.isNull()), F.lit(True)).cast("int") - 1)
    return F.coalesce(
        _field("log.logIndex", given["logIndex"], index, _U64[1]),
        F.when(F.coalesce(again, F.lit(False)), error("DuplicateLogIndex", "log index ", index.cast("string"), " appears more than once")),
        _field("log.address", given["address"], x["address"], _ADDRESS[1]),
        F.when(topic.isNotNull(), error("MalformedField", "field `log.topics` has an invalid value `", topic, f"`: {_WORD[1]}")),
        F.when(F.size(x["topics"]) > 4, error("MalformedField", "field `log.topics` has more than four topics")),
        _field("log.data", given["data"], x["data"], _BYTES[1]),
        F.when(index >= 1 << 32, error("MalformedField", "field `log.logIndex` has an invalid value `", given["logIndex"], "`: no hex number of 32 bits")),
    )


def _frame_error(f: Column, c: Column, p: Column) -> Column:
    """f: the frame as it is written, c: the call made of it, p: its place. Its changes and logs follow those of the frames before it."""
    path = _path_of(f)
    values = [(name, c[k] if k != "selector" else byte_digits(f[name]), how[1]) for k, (name, how) in _CALL.items()]
    return F.coalesce(
        F.when(F.size(f["path"]) > MAX_DEPTH, error("UnsupportedFeature", f"calls nest deeper than {MAX_DEPTH}")),
        F.when(c["kind"].isNull(), error("UnsupportedFeature", "call kind `", f["kind"], "`")),
        *(_field(f"call.{name}", f[name], value, why) for name, value, why in values),
        F.when(c["kind"].isin(*BORROWED) & p["context"].isNull(), error("UnsupportedFeature", "the root call borrows code, so it has no storage context")),
        first_of(F.transform(f["changes"], lambda s, i: _change_error(s, F.get("storage_changes", p["changes"] + i), path, p["context"]))),
        first_of(F.transform(f["logs"], lambda x, i: _log_error(x, F.get("read_logs", p["logs"] + i), F.col("indexes"), F.col("many")))),
    )


def _call(f: Column, p: Column, me: Column) -> Column:
    made = {k: how[0](f[name]) for k, (name, how) in _CALL.items()}
    made |= {"call_id": me, "parent_id": p["parent"], "kind": call_kind(f["kind"]), "depth": F.size(f["path"]), "succeeded": f["succeeded"], "selector": selector(f["input"])}
    return F.struct(*(made[k].alias(k) for k in columns_of(CALL)))


def _change(s: Column, p: Column, me: Column, i: Column) -> Column:
    made = {"id": p["changes"] + i, "call_id": me, "contract": address(s["contract"]), "slot": word(s["slot"]), "before": word(s["before"]), "after": word(s["after"])}
    return F.struct(*(made[k].alias(k) for k in columns_of(STORAGE)))


def _log(x: Column, p: Column, me: Column, i: Column) -> Column:
    made = {"id": p["logs"] + i, "call_id": me, "address": address(x["address"]), "topics": F.transform(x["topics"], word), "data": byte_digits(x["data"]), "log_index": u64(x["logIndex"])}
    return F.struct(*(made[k].alias(k) for k in columns_of(LOG)))


# Frames of a document whose texts are all valid: nothing is checked here but what depends on other frames.


def _exact_places(read: Column) -> Column:
    """For each frame, in visiting order: its parent and its storage context, as in placed."""

    def step(at: Column, x: Column) -> Column:
        depth = F.size(x["path"])
        up = F.get(at["above"], depth - 1)
        context = F.when(F.lower(x["kind"]).isin(*(k.lower() for k in BORROWED)), up["context"]).otherwise(F.lower(F.coalesce(x["to"], x["from"])))
        me = F.struct(F.size(at["out"]).alias("id"), context.alias("context"))
        above = F.array_append(F.slice(at["above"], F.lit(1), depth), me)
        place = F.struct(up["id"].alias("parent"), F.get(above, depth)["context"].alias("context"), F.lit(0).alias("changes"), F.lit(0).alias("logs")).cast(_PLACE)
        return F.struct(above.cast(_ABOVE).alias("above"), F.array_append(at["out"], place).alias("out"))

    start = F.struct(F.array().cast(_ABOVE).alias("above"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    return F.aggregate(read, start, step, lambda at: at["out"])


def _count(c: Column) -> Column:
    return F.conv(F.substring(c, 3, 16), 16, 10).cast("decimal(20,0)")


def _exact_calls(read: Column, places: Column) -> Column:
    def call(x: Column, me: Column) -> Column:
        made = {
            "call_id": me, "parent_id": F.get(places, me)["parent"], "kind": call_kind(x["kind"]), "depth": F.size(x["path"]), "from_addr": F.lower(x["from"]), "to_addr": F.lower(x["to"]),
            "value_hex": F.lpad(F.lower(F.substring(x["value"], 3, 32)), 32, "0"), "gas_limit": _count(x["gasLimit"]), "gas_used": _count(x["gasUsed"]), "succeeded": x["succeeded"],
            "selector": F.when(F.octet_length(x["input"]) >= 10, F.lower(F.substring(x["input"], 1, 10))),
        }
        return F.struct(*(made[k].alias(k) for k in columns_of(CALL)))

    return F.transform(read, call)


def _numbered(read: Column, name: str, made: Callable[[Column], dict[str, Column]], names: list[str]) -> Column:
    """What the frames hold under a name, one after the other: its place, its call and what is made of it."""
    whose = F.filter(F.transform(read, lambda x, me: F.struct(me.alias("me"), x[name].alias("own"))), lambda x: F.size(x["own"]) > 0)
    own = F.flatten(F.transform(whose, lambda x: F.transform(x["own"], lambda y: F.struct(x["me"].alias("me"), y.alias("y")))))

    def one(x: Column, i: Column) -> Column:
        fields_ = {"id": i, "call_id": x["me"]} | made(x["y"])
        return F.struct(*(fields_[k].alias(k) for k in names))

    return F.transform(own, one)


def _exact_changes(read: Column) -> Column:
    return _numbered(read, "storageChanges", lambda s: {k: F.lower(s[k]) for k in ("contract", "slot", "before", "after")}, columns_of(STORAGE))


def _exact_logs(read: Column) -> Column:
    def log(x: Column) -> dict[str, Column]:
        return {"address": F.lower(x["address"]), "topics": F.transform(x["topics"], F.lower), "data": F.lower(F.substring(x["data"], 3, (1 << 31) - 1)), "log_index": _count(x["logIndex"])}

    return _numbered(read, "logs", log, columns_of(LOG))


def _path_of(frame: Column) -> Column:
    return F.concat_ws(".", F.lit("root"), F.transform(frame["path"], lambda i: i.cast("string")))


def _exact_error(read: Column) -> Column:
    """The first storage change that is not its context's, or log whose index came before."""
    place = lambda s: F.get("places", s["call_id"])["context"]
    foreign = F.get(F.filter("storage_changes", lambda s: s["contract"] != place(s)), F.lit(0))
    again = F.when(F.col("many"), F.get(F.filter("read_logs", lambda x: F.array_position("indexes", x["log_index"]) <= x["id"]), F.lit(0)))

    def said(s: Column, x: Column) -> Column:
        own = error("InvalidStorageOwnership", "the call at ", _path_of(F.get(read, s["call_id"])), " declares ", s["contract"], "; its storage context is ", place(s))
        twice = error("DuplicateLogIndex", "log index ", x["log_index"].cast("string"), " appears more than once")
        return F.when(s.isNotNull() & (x.isNull() | (s["call_id"] <= x["call_id"])), own).when(x.isNotNull(), twice)

    return F.get(F.transform(F.array(F.struct(foreign.alias("s"), again.alias("x"))), lambda b: said(b["s"], b["x"])), F.lit(0))


def tx_of(source: Column, given: Column) -> Column:
    """The transaction of its fields as they are written."""
    tx = {k: how[0](given[k]) for k, (_, how) in _TX.items()} | {"source": source}
    return F.struct(*(tx[k].alias(k) for k in columns_of(TX)))


def tx_problem(given: Column, tx: Column) -> Column:
    return F.coalesce(*(_field(name, given[k], tx[k], how[1]) for k, (name, how) in _TX.items()))


def facts_of(rows: DataFrame) -> DataFrame:
    """Rows of trace_id, given (the fields of TX as they are written), frames and malformed (an error found on reading;
    null: none) to rows of trace_id, the trace's facts, error_kind and error. A trace with an error has no facts.
    Rows that were checked as a whole may have made (tx and its error), and exact and read instead of frames."""
    f, places = F.col("frames"), F.col("places")

    def all_of(name: str, one) -> Column:
        own = F.transform(f, lambda x, me: F.transform(x[name], lambda y, i: one(y, F.get(places, me), me, i)))
        return F.flatten(F.filter(own, lambda a: a.isNotNull()))

    checked = "exact" in rows.columns
    if not checked:
        rows = with_made(rows, tx=tx_of(F.col("trace_id"), F.col("given")))
        rows = with_made(rows, wrong=tx_problem(F.col("given"), F.col("tx"))).drop("given")
    calls = F.transform(f, lambda x, me: _call(x, F.get(places, me), me))
    changes, logs = all_of("changes", _change), all_of("logs", _log)
    where = placed(f)
    if checked:
        exact = F.col("exact")
        where = F.when(exact, _exact_places(F.col("read"))).otherwise(where)
        calls = F.when(exact, _exact_calls(F.col("read"), places)).otherwise(calls)
        changes, logs = F.when(exact, _exact_changes(F.col("read"))).otherwise(changes), F.when(exact, _exact_logs(F.col("read"))).otherwise(logs)
    read = with_made(with_made(rows, places=where), calls=calls, storage_changes=changes, read_logs=logs)
    read = with_made(read, indexes=F.transform("read_logs", lambda x: x["log_index"]))
    read = with_made(read, many=F.size(F.array_distinct("indexes")) < F.size("indexes"))
    static = F.get(F.filter("calls", lambda c: (c["kind"] == "StaticCall") & (c["value_hex"] != "0" * 32)), F.lit(0))["call_id"]
    found = first_of(F.transform(f, lambda x, me: _frame_error(x, F.get("calls", me), F.get(places, me))))
    problem = F.coalesce(
        F.col("malformed"),
        first_of(F.transform(f, lambda x: F.when(x["malformed"].isNotNull(), error("MalformedInput", x["malformed"])))),
        F.col("wrong"),
        F.when(F.col("exact"), _exact_error(F.col("read"))).otherwise(found) if checked else found,
        F.when(static.isNotNull(), error("ArenaConstruction", "static call ", static.cast("string"), " carries value")),
    )
    logs = F.transform("read_logs", lambda x: x.withField("log_index", x["log_index"].cast("long"))).cast(array_type("logs"))
    made = {"tx": F.col("tx").cast(struct_type(TX)), "calls": F.col("calls").cast(array_type("calls")), "storage_changes": F.col("storage_changes").cast(array_type("storage_changes")), "logs": logs}
    good = F.col("problem").isNull()
    out = with_made(read, problem=problem).select("trace_id", *(F.when(good, c).alias(k) for k, c in made.items()), F.col("problem.kind").alias("error_kind"), F.col("problem.detail").alias("error"))
    return out.withColumn("token_transfers", decode_transfers(F.col("logs")))


def decode_transfers(logs: Column) -> Column:
    """Token transfers of a trace's logs: the transfer signature, three topics, one word of data, addresses and an amount of their sizes."""

    def fits(x: Column) -> Column:
        t = x["topics"]
        return (
            (F.size(t) == 3) & (F.get(t, F.lit(0)) == TRANSFER_TOPIC) & (F.length(x["data"]) == 64)
            & topic_address(F.get(t, F.lit(1))).isNotNull() & topic_address(F.get(t, F.lit(2))).isNotNull()
            & (F.substring(x["data"], 1, 32) == "0" * 32)
        )

    return F.transform(
        F.filter(logs, lambda x: F.coalesce(fits(x), F.lit(False))),
        lambda x, i: F.struct(
            i.alias("id"), x["id"].alias("log_id"), x["call_id"].alias("call_id"), x["address"].alias("token"),
            topic_address(F.get(x["topics"], F.lit(1))).alias("from_addr"), topic_address(F.get(x["topics"], F.lit(2))).alias("to_addr"),
            F.substring(x["data"], 33, 32).alias("amount_hex"),
        ),
    ).cast(array_type("token_transfers"))


def ingest(documents: DataFrame) -> DataFrame:
    """(trace_id, doc) to rows of trace_id, error_kind, error and the trace; a trace with an error has no facts."""
    v, t, plain, exact = F.col("v"), F.col("t"), F.col("plain"), F.col("exact")
    rows = with_made(documents.select(F.col("trace_id").cast("string").alias("trace_id"), "doc"), t=F.from_json("doc", _DOCUMENT, READ))
    rows = with_made(rows, read=F.when(t["bad"].isNull() & t["root"].isNotNull(), in_order(t["root"], _FIELDS)))
    outer = [t[what][n] for what in ("transaction", "block") for n in OBJECTS[what]]
    around = F.when(_needed(t["transaction"], "transaction") & _needed(t["block"], "block"), held(present(*outer) + 3, present(*outer), F.lit(3), F.lit(0)))
    rows = with_checks(rows)
    rows = with_made(rows, plain=all_read(F.col("doc"), F.col("read"), _holds, around, F.col("quick")))
    parsed = with_made(rows, v=F.when(~plain, parse(F.col("doc"))))
    shapes = [misshapen(v, "document"), *(misshapen(part(v, k), k) for k in ("transaction", "block"))]
    malformed = (
        F.when(F.col("doc").isNull(), error("SourceUnavailable", "the document is null"))
        .when(plain, F.lit(None))
        .when(v.isNull(), error("MalformedInput", "not one JSON object"))
        .otherwise(F.when(F.coalesce(*shapes).isNotNull(), error("MalformedInput", F.coalesce(*shapes))))
    )
    places = {k: name.split(".") for k, (name, _) in _TX.items()}
    given = [F.when(plain, t[what][n]).otherwise(text_of(part(v, what), n)).alias(k) for k, (what, n) in places.items()]
    made = with_made(parsed, malformed=malformed, given=F.struct(*given), root=F.when(~plain, part(v, "root")))
    made = with_made(made.drop("t", "v"), tx=tx_of(F.col("trace_id"), F.col("given")))
    made = with_made(made, wrong=tx_problem(F.col("given"), F.col("tx")))
    borrows = F.coalesce(F.lower(F.get("read", F.lit(0))["kind"]).isin(*(k.lower() for k in BORROWED)), F.lit(False))
    found = F.col("wrong").isNotNull()  # so nothing is asked of the frames
    made = made.withColumn("exact", plain & F.col("quick") & exact & ~found & ~borrows)
    none = F.array().cast(FRAMES)
    frames = F.when(exact | plain & found, none).when(plain, written(F.col("read"), _written)).when(F.col("malformed").isNull(), unfolded(F.col("root"), F.col("doc"), document_frame)).otherwise(none)
    made = with_made(made, frames=frames).select("trace_id", "malformed", "tx", "wrong", "exact", F.when(exact, F.col("read")).alias("read"), "frames")
    return facts_of(made)


def traces_of(ingested: DataFrame) -> DataFrame:
    """The good rows, enriched."""
    return enrich_traces(ingested.where(F.col("error_kind").isNull()).drop("error_kind", "error"))


def errors_of(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("error_kind").isNotNull()).select("trace_id", "error_kind", "error")


class TraceSource(Protocol):
    """Anything that gives documents: (trace_id, doc)."""

    def documents(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class Files:
    """One document for each file of a path or pattern: trace_id is the file's path."""

    path: str

    def documents(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.text(self.path, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("doc"))
        except AnalysisException as e:
            raise IngestionError("SourceUnavailable", str(e).splitlines()[0]) from None


@dataclass(frozen=True)
class InMemory:
    texts: dict[str, str]

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.texts.items()), "trace_id string, doc string")


def ingest_from(spark: SparkSession, source: TraceSource) -> DataFrame:
    """The documents of a source, ingested."""
    return ingest(source.documents(spark))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return Files(path).documents(spark)


def in_memory(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    return InMemory(documents).documents(spark)
