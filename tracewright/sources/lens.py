"""Execution traces derived from order tables.

Orders are transactions and their lines are calls, so the engine can run on any star schema
of that kind, at any size. Addresses are small numbers, so that calls re-enter often. An
order's lines are gathered into one row, in order; all else is said about that row, so lines
are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TX, Relations, array_type, columns_of, struct_type, to_relations
from ..operators.enrich import BORROWED, enrich_traces
from .documents import TRANSFER_TOPIC, decode_transfers

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
REST = ["l_quantity", "l_returnflag", "l_linestatus"]
# Fixed values of the lens.
KINDS = ["Call"] * 5 + ["StaticCall", "DelegateCall", "CallCode", "Create", "Selfdestruct"]
OTHER_TOPIC = "0x" + "1" * 64
SMALL = 64


def _hex(c: Column, digits: int) -> Column:
    """Lower-case digits. Most numbers of the lens are small: theirs are looked up in a constant, others are made."""
    known = F.array(*(F.lit(f"{i:0{digits}x}") for i in range(SMALL)))
    return F.coalesce(F.get(known, c.cast("int")), F.lower(F.lpad(F.hex(c.cast("long")), digits, "0")))


def _prefixed(c: Column, digits: int) -> Column:
    known = F.array(*(F.lit(f"0x{i:0{digits}x}") for i in range(SMALL)))
    return F.coalesce(F.get(known, c.cast("int")), F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c.cast("long")), digits, "0"))))


def _address(c: Column) -> Column:
    return _prefixed(c, 40)


def _word(c: Column) -> Column:
    return _prefixed(c, 64)


def _to(line: Column) -> Column:
    return _address(line["l_suppkey"] % 4)


def _call(x: Column, n: Column, only: set[str] | None) -> Column:
    parent = F.when(n == 0, F.lit(None)).when(x["l_linenumber"] % 2 == 0, n - 1).otherwise(F.floor((n - 1) / 2)).cast("int")
    kind = F.when(n == 0, "Call").otherwise(F.get(F.array(*map(F.lit, KINDS)), (x["l_partkey"] % 10).cast("int")))
    value = F.when((x["l_suppkey"] % 2 == 1) & (kind != "StaticCall"), F.floor(x["l_quantity"])).otherwise(0)
    fields = {
        "call_id": n, "parent_id": parent, "kind": kind, "depth": F.lit(None).cast("int"),
        "from_addr": F.when(n == 0, _address(F.col("o_custkey") % 7)).otherwise(_to(F.get("lines", parent))), "to_addr": _to(x),
        "value_hex": _hex(value, 32), "gas_limit": F.lit(0).cast("decimal(20,0)"), "gas_used": F.lit(0).cast("decimal(20,0)"),
        "succeeded": x["l_linestatus"] == "F", "selector": _prefixed(x["l_partkey"] % 16, 8),
    }
    return F.struct(*((c if only is None or k in only else F.lit(None)).alias(k) for k, c in fields.items()))


def _storage_change(x: Column, i: Column) -> Column:
    before = F.floor(x["l_quantity"]).cast("long")
    fields = {
        "id": i, "call_id": x["n"], "contract": _to(x), "slot": _word(x["l_partkey"] % 3),
        "before": _word(before), "after": _word(before + x["l_suppkey"] % 2),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def _log(x: Column, i: Column) -> Column:
    topics = [F.when(x["l_suppkey"] % 2 == 0, TRANSFER_TOPIC).otherwise(OTHER_TOPIC), _word(x["l_suppkey"] % 7), _word(x["l_linenumber"] % 7)]
    fields = {
        "id": i, "call_id": x["n"], "address": _to(x),
        "topics": F.when(x["l_partkey"] % 3 == 0, F.array(*topics[:2])).otherwise(F.array(*topics)),
        "data": F.when(x["l_partkey"] % 3 == 1, _hex(F.floor(x["l_quantity"]), 64)).otherwise(_hex(F.floor(x["l_quantity"]), 62)),
        "log_index": x["n"].cast("long"),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def raw_traces(spark: SparkSession, sf_dir: str, call_fields: set[str] | None = None) -> DataFrame:
    """Trace rows: one for each order with lines. With `call_fields`, the other fields of calls are null and cost nothing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey IS NOT NULL")
    gathered = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ORDER, *REST))).alias("lines"))
    gathered = gathered.withColumn("lines", F.transform("lines", lambda x, n: F.struct(n.alias("n"), *(x[c].alias(c) for c in (*ORDER, *REST)))))
    rows = gathered.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tx = {
        "tx_hash": _word(F.col("o_orderkey")), "from_addr": _address(F.col("o_custkey") % 7), "to_addr": F.lit(None).cast("string"),
        "value_hex": F.lit("0" * 32), "nonce": F.lit(0), "gas_used": F.floor("o_totalprice"),
        "status": F.when(F.col("o_orderstatus") == "F", "Reverted").otherwise("Success"), "block_number": F.col("o_orderkey"),
        "block_ts": F.unix_timestamp("o_orderdate"), "chain_id": F.lit(1), "base_fee_hex": F.lit(None).cast("string"), "source": F.lit("orders"),
    }

    def flagged(flag: str) -> Column:
        return F.filter("lines", lambda x: x["l_returnflag"] == flag)

    made = rows.select(
        F.col("o_orderkey").alias("trace_id"),
        F.struct(*(tx[k].alias(k) for k in columns_of(TX))).cast(struct_type(TX)).alias("tx"),
        F.transform("lines", lambda x, n: _call(x, n, call_fields)).cast(array_type("calls")).alias("calls"),
        F.transform(flagged("R"), _storage_change).cast(array_type("storage_changes")).alias("storage_changes"),
        F.transform(flagged("A"), _log).cast(array_type("logs")).alias("logs"),
    )
    return made.withColumn("token_transfers", decode_transfers(F.col("logs")))


WALKED = {"call_id", "parent_id", "kind", "from_addr", "to_addr"}  # fields of calls that facts about the calls above come from


def traces(spark: SparkSession, sf_dir: str, call_fields: set[str] | None = None) -> DataFrame:
    """Trace rows, enriched; with `call_fields`, of these fields of calls and of those that are WALKED."""
    return enrich_traces(raw_traces(spark, sf_dir, call_fields and call_fields | WALKED))


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    return to_relations(raw_traces(spark, sf_dir))


def documents(rows: DataFrame) -> DataFrame:
    """Trace rows as documents (trace_id, doc): all calls but the first are the first one's own calls."""

    def frame(c: Column) -> list[Column]:
        context = F.when(c["kind"].isin(*BORROWED), F.get("calls", F.lit(0))["to_addr"]).otherwise(c["to_addr"])
        changes = F.transform(
            F.filter("storage_changes", lambda s: s["call_id"] == c["call_id"]),
            lambda s: F.struct(context.alias("contract"), s["slot"].alias("slot"), s["before"].alias("before"), s["after"].alias("after")),
        )
        logs = F.transform(
            F.filter("logs", lambda x: x["call_id"] == c["call_id"]),
            lambda x: F.struct(x["address"].alias("address"), x["topics"].alias("topics"), F.concat(F.lit("0x"), x["data"]).alias("data"), F.concat(F.lit("0x"), F.hex(x["log_index"])).alias("logIndex")),
        )
        named = {
            "kind": F.lower(c["kind"]), "from": c["from_addr"], "to": c["to_addr"], "value": F.concat(F.lit("0x"), c["value_hex"]), "gasLimit": F.lit("0x0"), "gasUsed": F.lit("0x0"),
            "succeeded": c["succeeded"], "input": c["selector"], "storageChanges": changes, "logs": logs,
        }
        return [v.alias(k) for k, v in named.items()]

    inner = F.transform(F.slice("calls", F.lit(2), F.size("calls")), lambda c: F.struct(*frame(c)))
    t = F.col("tx")
    transaction = {"hash": t["tx_hash"], "from": t["from_addr"], "value": F.lit("0x0"), "nonce": F.lit("0x0"), "gasUsed": F.concat(F.lit("0x"), F.hex(t["gas_used"].cast("long"))), "status": F.lower(t["status"])}
    block = {"number": F.concat(F.lit("0x"), F.hex(t["block_number"].cast("long"))), "timestamp": F.lit("0x0"), "chainId": F.lit("0x1")}
    root = F.struct(*frame(F.get("calls", F.lit(0))), inner.alias("calls"))
    doc = F.struct(F.struct(*(v.alias(k) for k, v in transaction.items())).alias("transaction"), F.struct(*(v.alias(k) for k, v in block.items())).alias("block"), root.alias("root"))
    return rows.select("trace_id", F.to_json(doc).alias("doc"))


# ------------------------------------------------------------------ trees of calls


def contexts(calls: Column) -> Column:
    """The storage context of each call of sound traces, by a fold: parents come first."""

    def own(seen: Column, c: Column) -> Column:
        borrowed = F.coalesce(c["kind"].isin(*BORROWED), F.lit(False)) & c["parent_id"].isNotNull()
        return F.array_append(seen, F.when(borrowed, F.get(seen, c["parent_id"])).otherwise(F.coalesce(c["to_addr"], c["from_addr"])))

    return F.aggregate(calls, F.array().cast("array<string>"), own)


def nested(calls: Column, objects: Column) -> Column:
    """The objects (JSON texts) of a trace's calls as one text: each holds those of its own calls. Made from the last call backwards."""

    def step(held: Column, i: Column) -> Column:
        own, parent = F.get(objects, i), F.coalesce(F.get(calls, i)["parent_id"], F.lit(-1))
        text = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"calls":['), F.get(held, i), F.lit("]}"))

        def put(x: Column, j: Column) -> Column:
            return F.when(j == parent, F.concat(text, F.when(x == "", "").otherwise(","), x)).when((parent < 0) & (j == i), text).otherwise(x)

        return F.transform(held, put)

    n = F.size(calls)
    return F.get(F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.transform(objects, lambda _: F.lit("")), step), F.lit(0))


def nested_documents(rows: DataFrame) -> DataFrame:
    """Trace rows as documents (trace_id, doc) whose calls nest as they were made."""
    t = F.col("tx")

    def frame(c: Column, i: Column) -> Column:
        changes = F.transform(
            F.filter("storage_changes", lambda s: s["call_id"] == c["call_id"]),
            lambda s: F.struct(F.get("contexts", i).alias("contract"), s["slot"].alias("slot"), s["before"].alias("before"), s["after"].alias("after")),
        )
        named = {
            "kind": F.lower(c["kind"]), "from": c["from_addr"], "to": c["to_addr"], "value": F.concat(F.lit("0x"), c["value_hex"]), "gasLimit": F.lit("0x0"), "gasUsed": F.lit("0x0"),
            "succeeded": c["succeeded"], "input": c["selector"], "storageChanges": changes,
        }
        return F.to_json(F.struct(*(v.alias(k) for k, v in named.items())))

    transaction = {"hash": t["tx_hash"], "from": t["from_addr"], "value": F.lit("0x0"), "nonce": F.lit("0x0"), "gasUsed": F.lit("0x0"), "status": F.lower(t["status"])}
    head = F.struct(*(v.alias(k) for k, v in transaction.items()))
    block = F.struct(F.concat(F.lit("0x"), F.hex(t["block_number"].cast("long"))).alias("number"), F.lit("0x0").alias("timestamp"), F.lit("0x1").alias("chainId"))
    made = rows.withColumn("contexts", contexts(F.col("calls"))).withColumn("objects", F.transform("calls", frame))
    parts = (F.lit('{"transaction":'), F.to_json(head), F.lit(',"block":'), F.to_json(block), F.lit(',"root":'), nested(F.col("calls"), F.col("objects")), F.lit("}"))
    return made.select("trace_id", F.concat(*parts).alias("doc"))


def tracer_documents(rows: DataFrame) -> DataFrame:
    """Trace rows as a call tracer writes them: (trace_id: the transaction's hash, doc)."""

    def frame(c: Column) -> Column:
        named = {
            "type": F.upper(c["kind"]), "from": c["from_addr"], "to": c["to_addr"], "value": F.concat(F.lit("0x"), F.ltrim(c["value_hex"], F.lit("0")), F.when(c["value_hex"] == "0" * 32, "0").otherwise("")),
            "gas": F.lit("0x5208"), "gasUsed": F.lit("0x1"), "input": F.concat(c["selector"], F.lit("00")), "output": F.lit("0x"), "error": F.when(~c["succeeded"], "execution reverted"),
        }
        return F.to_json(F.struct(*(v.alias(k) for k, v in named.items())))

    made = rows.withColumn("objects", F.transform("calls", frame))
    reply = F.concat(F.lit('{"jsonrpc":"2.0","id":1,"result":'), nested(F.col("calls"), F.col("objects")), F.lit("}"))
    return made.select(F.col("tx.tx_hash").alias("trace_id"), reply.alias("doc"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tracer does not say of a transaction, from the orders: tx_hash, nonce, block_number, block_ts, chain_id."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = lambda c: F.concat(F.lit("0x"), F.hex(c))
    return orders.select(
        _word(F.col("o_orderkey")).alias("tx_hash"), text(F.col("o_custkey").cast("long")).alias("nonce"), text(F.floor("o_totalprice")).alias("block_number"),
        text(F.unix_timestamp("o_orderdate")).alias("block_ts"), F.lit("0x5").alias("chain_id"),
    )
