"""The call tracer output of common nodes, as trace documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexcodec import KIND_CLASSES, word
from ..model import columns_of, fields_of
from .documents import FRAMES, READ, WRITTEN, IngestionError, all_read, error, facts_of, fields, frame_type, held, in_order, list_of, parse, part, present, text_of, unfolded, with_made, written

_KINDS = {k.lower() for k in KIND_CLASSES}
_CALL_FIELDS = {"to": "to", "input": "input"}


def convert(text: str, tx_hash: str, block_number: str, chain_id: str, nonce: str = "0x0") -> dict:
    """A tracer's frame (bare, or the `result` of a reply) to a trace document.

    The tracer records no storage changes or logs, so there are none; the timestamp is 0. A
    frame succeeded if it has no error, and the transaction as its root did. Fields that a
    document doesn't know are left out.
    """
    try:
        root = json.loads(text)
        root = root["result"] if isinstance(root, dict) and isinstance(root.get("result"), dict) else root
        frame = _frame(root)
        return {
            "transaction": {
                "hash": tx_hash, "from": root["from"], "to": root.get("to"), "value": root.get("value") or "0x0", "nonce": nonce,
                "gasUsed": root["gasUsed"], "status": "success" if frame["succeeded"] else "reverted",
            },
            "block": {"number": block_number, "timestamp": "0x0", "chainId": chain_id, "baseFee": None},
            "root": frame,
        }
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as e:
        raise e if isinstance(e, IngestionError) else IngestionError("MalformedInput", f"not a call tracer frame: {e!r}") from None


def _frame(root: dict) -> dict:
    out: dict = {}
    left = [(root, out)]
    while left:
        f, made = left.pop()
        kind = f["type"].lower()
        if kind not in _KINDS:
            raise IngestionError("UnsupportedFeature", f"call kind `{f['type']}`")
        made |= {"kind": kind, "from": f["from"], "value": f.get("value") or "0x0", "gasLimit": f["gas"], "gasUsed": f["gasUsed"]}
        made |= {"succeeded": f.get("error") is None, "storageChanges": [], "logs": [], "calls": []}
        made |= {ours: f[theirs] for theirs, ours in _CALL_FIELDS.items() if f.get(theirs) is not None}
        for child in f.get("calls") or ():
            made["calls"].append({})
            left.append((child, made["calls"][-1]))
    return out


# Fields of a tracer's frame that must be texts, and those that may be missing or null.
NEEDED, OPTIONAL = ("type", "from", "gas", "gasUsed"), ("to", "value", "input")
ZERO_HASH = "0x" + "0" * 64


def tracer_frame(x: Column) -> list[Column]:
    """The columns of documents.WRITTEN for a tracer's frame."""
    kind = lambda n: F.schema_of_variant(part(x, n))
    odd = [F.when(~F.coalesce(kind(n) == "STRING", F.lit(False)), n) for n in NEEDED]
    odd += [F.when(part(x, n).isNotNull() & ~kind(n).isin("STRING", "VOID"), n) for n in OPTIONAL]
    odd.append(F.when(part(x, "calls").isNotNull() & list_of(x, "calls").isNull() & (kind("calls") != "VOID"), "calls"))
    named = {
        "kind": F.lower(text_of(x, "type")), "from": text_of(x, "from"), "to": text_of(x, "to"), "value": F.coalesce(F.nullif(text_of(x, "value"), F.lit("")), F.lit("0x0")),
        "gasLimit": text_of(x, "gas"), "gasUsed": text_of(x, "gasUsed"), "succeeded": F.coalesce(kind("error") == "VOID", F.lit(True)), "input": text_of(x, "input"),
        "changes": F.lit(None), "logs": F.lit(None), "malformed": F.concat(F.lit("not a call tracer frame: field `"), F.coalesce(*odd), F.lit("`")),
    }
    return [c.cast(kind).alias(n) for (n, c), (_, kind) in zip(named.items(), fields_of(WRITTEN))]


# What is read by a schema: a reply, with these texts in its frames.
_TEXTS = (*NEEDED, *OPTIONAL, "output", "error", "revertReason")
_REPLY = f"struct<jsonrpc: string, id: bigint, result: {frame_type(', '.join(f'`{n}`: string' for n in _TEXTS))}, bad: string>"


def _holds(x: Column) -> Column:
    """What a frame of _REPLY holds; null if it lacks what it needs."""
    texts, lists = present(*(x[n] for n in _TEXTS)), x["lists"].cast("int")
    return F.when(present(*(x[n] for n in NEEDED)) == len(NEEDED), held(texts + lists, texts, F.lit(1), lists))


def _written(x: Column) -> list[Column]:
    """The columns of WRITTEN for a frame of _REPLY."""
    own = {"from": x["from"], "to": x["to"], "gasUsed": x["gasUsed"], "input": x["input"]}
    own |= {"kind": F.lower(x["type"]), "value": F.coalesce(F.nullif(x["value"], F.lit("")), F.lit("0x0")), "gasLimit": x["gas"], "succeeded": x["error"].isNull()}
    return [own.get(n, F.lit(None)).alias(n) for n in columns_of(WRITTEN)]


def ingest_call_tracer(documents: DataFrame, block_number: str = "0x0", chain_id: str = "0x1", context: DataFrame | None = None) -> DataFrame:
    """Rows of (trace_id, doc); the trace id is taken for the transaction hash if it is one, else the hash is zero.

    `context` has what the tracer does not say: rows of tx_hash, nonce, block_number, block_ts, chain_id (texts in
    hex, as receipts and blocks have them), joined by hash. Where it has no row, or null, nonce and time are zero
    and block and chain the ones given. Of several rows for a hash the smallest counts. A null document is an
    error row, a null trace id no hash.
    """
    own = documents.select(F.col("trace_id").cast("string").alias("trace_id"), "doc")
    own = own.withColumn("tx_hash", F.coalesce(word(F.col("trace_id")), F.lit(ZERO_HASH)))
    told = ("nonce", "block_number", "block_ts", "chain_id")
    if context is None:
        own = own.withColumns({k: F.lit(None).cast("string") for k in told})
    else:
        rows = context.select(word(F.col("tx_hash")).alias("tx_hash"), F.struct(*told).alias("c")).where("tx_hash IS NOT NULL")
        own = own.join(rows.groupBy("tx_hash").agg(F.min("c").alias("c")), "tx_hash", "left").select("trace_id", "doc", "tx_hash", "c.*")
    t = F.col("t")
    around = held(present(t["jsonrpc"], t["id"], t["result"]), present(t["jsonrpc"]), F.lit(1), F.lit(0))
    rows = with_made(own, t=F.from_json("doc", _REPLY, READ))
    rows = with_made(rows, alone=F.when(t["result"].isNull(), F.from_json(F.concat(F.lit('{"result":'), F.col("doc"), F.lit("}")), _REPLY, READ)))
    one = F.when(t["result"].isNull(), F.col("alone")).otherwise(t)
    rows = with_made(rows, read=F.when(one["bad"].isNull() & one["result"].isNotNull(), in_order(F.coalesce(t["result"], F.col("alone.result")), _TEXTS)))
    around = F.when(t["result"].isNull(), held(*[F.lit(0)] * 4)).otherwise(around)
    rows = with_made(rows, plain=all_read(F.col("doc"), F.col("read"), _holds, around))
    reply = F.when(~F.col("plain"), parse(F.col("doc")))
    frame = F.when(fields(part(F.col("reply"), "result")).isNotNull(), part(F.col("reply"), "result")).otherwise(F.col("reply"))
    rows = with_made(with_made(rows, reply=reply), v=frame)
    malformed = (
        F.when(F.col("doc").isNull(), error("SourceUnavailable", "the document is null"))
        .when(~F.col("plain") & F.col("v").isNull(), error("MalformedInput", "not a call tracer frame"))
    )
    rows = with_made(rows, malformed=malformed)
    frames = F.when(F.col("plain"), written(F.col("read"), _written)).when(F.col("malformed").isNull(), unfolded(F.col("v"), F.col("doc"), tracer_frame)).otherwise(F.array().cast(FRAMES))
    rows = with_made(rows, frames=frames)
    root = F.get("frames", F.lit(0))
    zero = {"nonce": "0x0", "block_number": block_number, "block_ts": "0x0", "chain_id": chain_id}
    given = {
        "tx_hash": F.col("tx_hash"), "from_addr": root["from"], "to_addr": root["to"], "value_hex": root["value"], "gas_used": root["gasUsed"],
        "status": F.when(root["succeeded"], "success").otherwise("reverted"), "base_fee_hex": F.lit(None).cast("string"), **{k: F.coalesce(F.col(k), F.lit(v)) for k, v in zero.items()},
    }
    return facts_of(rows.select("trace_id", "malformed", "frames", F.struct(*(v.alias(k) for k, v in given.items())).alias("given")))
