"""A stable name for a candidate: FNV-1a, 64 bits, over its pattern and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public FNV-1a constants.
OFFSET_BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = OFFSET_BASIS
    for byte in data:
        h = (h ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def message(pattern_id: str, version: int, cited: list[tuple[int, str, int]]) -> bytes:
    """What is hashed: texts end with 0xff, numbers are 64-bit little-endian."""
    out = pattern_id.encode() + b"\xff" + version.to_bytes(8, "little")
    for clause, kind, fact in sorted(cited):
        out += clause.to_bytes(8, "little") + f"{kind}({kind}Id({fact}))".encode() + b"\xff"
    return out


def _text_bytes(text: Column) -> Column:
    return F.transform(F.split(text, ""), F.ascii)


def _number_bytes(n: Column) -> Column:
    """A small number as eight bytes, the lowest first."""
    return F.array(*(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255).cast("int") for i in range(8)))


_LOW = 0xFFFFFFFF


def _mixed(h: Column, byte: Column) -> Column:
    """One step, on two halves of 32 bits: the prime is 2^40 + 0x1b3, so no product leaves 64 bits."""
    low = h["low"].bitwiseXOR(byte.cast("long"))
    product = low * (PRIME & 0xFFFF)
    high = h["high"] * (PRIME & 0xFFFF) + F.shiftright(product, 32) + F.shiftleft(low, 8)
    return F.struct(high.bitwiseAND(_LOW).alias("high"), product.bitwiseAND(_LOW).alias("low"))


def candidate_id(findings: DataFrame) -> DataFrame:
    """Adds candidate_id, 16 hex digits. Pattern names are plain ASCII (identifiers of the language)."""
    end = F.array(F.lit(255))
    cited = F.array_sort(F.transform("bindings", lambda b: F.struct(b["clause"].alias("clause"), b["fact_kind"].alias("fact_kind"), b["fact_id"].alias("fact_id"))))
    each = F.transform(
        cited,
        lambda b: F.concat(_number_bytes(b["clause"]), _text_bytes(F.concat(b["fact_kind"], F.lit("("), b["fact_kind"], F.lit("Id("), b["fact_id"].cast("string"), F.lit("))"))), end),
    )
    data = F.concat(_text_bytes(F.col("pattern_id")), end, _number_bytes(F.col("pattern_version")), F.flatten(each))
    start = F.struct(F.lit(OFFSET_BASIS >> 32).cast("long").alias("high"), F.lit(OFFSET_BASIS & _LOW).cast("long").alias("low"))
    h = F.aggregate(data, start, _mixed, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))
    return findings.withColumn("candidate_id", h)
