"""Order-preserving key codecs. All are expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_key(text: Column | str) -> Column:
    """UTF-8 bytes; their order is the order of code points."""
    return F.encode(_column(text), "UTF-8")


def decode_text(key: Column | str) -> Column:
    return F.decode(_column(key), "UTF-8")


def padded_key(prefix: str, number: Column | str, width: int) -> Column:
    """prefix and a zero-padded decimal, for numbers from 0 to 10^width - 1."""
    return text_key(F.concat(F.lit(prefix), F.lpad(_column(number).cast("long").cast("string"), width, "0")))


def bigint_key(number: Column | str) -> Column:
    """Eight bytes, big endian, with the sign bit turned, so that negative numbers come first."""
    return F.unhex(F.lpad(F.hex(_column(number).cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def decode_bigint(key: Column | str) -> Column:
    digits = F.hex(_column(key))
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return (F.shiftleft(high, 32) + low).bitwiseXOR(F.lit(_SIGN))


def double_key(number: Column | str, scale: int = 2) -> Column:
    """A decimal of fixed scale as its scaled integer."""
    return bigint_key(F.round(_column(number) * 10**scale).cast("long"))


def composite_key(*parts: Column) -> Column:
    """Parts of fixed width, or a last one of any, one after the other: byte order is the order of the tuple."""
    return F.concat(*parts)
