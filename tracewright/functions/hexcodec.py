"""Hex strings to canonical values, as column functions. A value that doesn't parse is null.

Addresses and words are lower-case with 0x; unsigned 128-bit amounts are 32 lower-case hex
digits, so that text order is numeric order; 64-bit counts are decimal(20, 0).

Inside of lambdas an expression is evaluated as often as it is written, so patterns are written once or twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U128_HEX = "f" * 32


def _number(width: int) -> str:
    """An unsigned number of so many significant hex digits at most, which are its group."""
    return rf"^(?:0x)?\+?0*([0-9a-fA-F]{{1,{width}}})\z"


def u64(c: Column) -> Column:
    return F.conv(F.regexp_extract(c, _number(16), 1), 16, 10).cast("decimal(20,0)")  # conv of no digits is null


def u128(c: Column) -> Column:
    return F.when(c.rlike(_number(32)), F.lower(F.lpad(F.regexp_extract(c, _number(32), 1), 32, "0")))


def u128_halves(amount: Column) -> tuple[Column, Column]:
    """The upper and the lower 64 bits of a 32-digit amount, as numbers whose sums stay exact over any number of rows."""
    return tuple(F.conv(F.substring(amount, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


# 2^64, the unit in which wide numbers are written, and 2^127 in such units.
_WORD, PART = 1 << 64, 10**18
_TOP, _LOW = divmod(1 << 127, PART)


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def signed_digits(high: Column, low: Column) -> Column:
    """The decimal digits of high * 2^64 + low (sums of halves, with a sign), as a text; null beyond 128 signed bits.

    Such a number may have 39 digits, one more than a decimal column; so it is made of two: of units of 10^18 and of the rest.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    part = lambda c: exact(F.pmod(c, _whole(PART)))
    floor = lambda c: exact(exact(c - part(c)) / _whole(PART))
    high, low = exact(high), exact(low)
    units = exact(floor(high) * _whole(_WORD))
    rest = exact(exact(part(high) * _whole(_WORD)) + low)
    units, rest = exact(units + floor(rest)), part(rest)
    top, low_end = _whole(_TOP), _whole(-_TOP - 1)
    fits = ((units < top) | ((units == top) & (rest < _whole(_LOW)))) & ((units > low_end) | ((units == low_end) & (rest >= _whole(PART - _LOW))))
    negative = units < 0
    borrowed = negative & (rest > 0)
    units = F.when(negative, exact(-units) - borrowed.cast("int")).otherwise(units).cast("decimal(38,0)")
    rest = F.when(borrowed, exact(_whole(PART) - rest)).otherwise(rest).cast("decimal(38,0)")
    digits = F.when(units == 0, rest.cast("string")).otherwise(F.concat(units.cast("string"), F.lpad(rest.cast("string"), 18, "0")))
    return F.when(fits, F.concat(F.when(negative, "-").otherwise(""), digits))


def u128_decimal(amount: Column) -> Column:
    """The number of a 32-digit amount; null from 10^38."""
    high, low = (c.cast("decimal(38,0)") for c in u128_halves(amount))
    shifted = F.try_multiply(high, F.lit(str(_WORD)).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.try_add(shifted, low).cast("decimal(38,0)")


def _fixed(c: Column, width: int) -> Column:
    return F.when(c.rlike(rf"^(?:0x)?[0-9a-fA-F]{{{width}}}\z"), F.concat(F.lit("0x"), F.lower(F.substring(c, -width, width))))


def address(c: Column) -> Column:
    return _fixed(c, 40)


def word(c: Column) -> Column:
    return _fixed(c, 64)


def byte_digits(data: Column) -> Column:
    """The lower-case digits of whole bytes; null for an odd number of digits or other characters."""
    whole = (F.length(data) % 2 == 0) & data.rlike(r"^(?:0x)?[0-9a-fA-F]*\z")
    return F.when(whole, F.lower(F.when(data.startswith("0x"), F.substring(data, 3, (1 << 31) - 1)).otherwise(data)))


def selector(data: Column) -> Column:
    """The first four bytes of call data, where there are as many."""
    d = byte_digits(data)
    return F.when(F.length(d) >= 8, F.concat(F.lit("0x"), F.substring(d, 1, 8)))


def raw(data: Column) -> Column:
    """Bytes; null for an odd number of digits or other characters."""
    return F.unhex(byte_digits(data))


# The call kinds of a trace, and the class by which patterns name them.
KIND_CLASSES = {
    "Call": "External",
    "StaticCall": "StaticCall",
    "DelegateCall": "Delegate",
    "CallCode": "Delegate",
    "Create": "Create",
    "Create2": "Create",
    "Selfdestruct": "SelfDestruct",
}


def call_kind(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kind in KIND_CLASSES for x in (kind.lower(), kind)))
    return F.try_element_at(known, F.lower(c))


def kind_class(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, known in KIND_CLASSES.items():
        out = out.when(kind == name, known)
    return out


def class_bit(name: str) -> int:
    """The bit of a class in a set of classes; 0 for classes that no call has."""
    known = list(dict.fromkeys(KIND_CLASSES.values()))
    return 1 << known.index(name) if name in known else 0


def kind_bit(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, known in KIND_CLASSES.items():
        out = out.when(kind == name, class_bit(known))
    return F.coalesce(out, F.lit(0))


def topic_address(topic: Column) -> Column:
    """The address in a topic; null unless its first 12 bytes are zero."""
    return F.when(F.substring(topic, 3, 24) == "0" * 24, F.concat(F.lit("0x"), F.substring(topic, 27, 40)))
