"""Order-preserving primary-key bytes as column expressions.

Keys compare as unsigned bytes. A string key is its UTF-8 bytes. A number key is eight bytes, little-endian
(``le``, the command language's order) or big-endian (``be``, numeric order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)
MAX_U64 = (1 << 64) - 1


def u64_hex(c: Column, wide: bool = True) -> Column:
    """Sixteen hex digits; ``wide`` if values can be 2^63 or more (a decimal column)."""
    if wide:
        c = F.when(c >= F.lit(str(1 << 63)).cast(U64), c - F.lit(str(1 << 64)).cast(T.DecimalType(21, 0))).otherwise(c).cast("bigint")
    return F.lpad(F.hex(c), 16, "0")


def swap_hex(h: Column) -> Column:
    """The bytes of sixteen hex digits in reverse order."""
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def key_column(c: Column, kind: T.DataType, order: str = "le") -> Column:
    """The key bytes of a column of this type."""
    if isinstance(kind, T.StringType):
        return c.cast("binary")
    if isinstance(kind, T.BinaryType):
        return c
    h = u64_hex(c, wide=isinstance(kind, T.DecimalType))
    return F.unhex(swap_hex(h) if order == "le" else h)


def key_bytes(value: str | int, order: str = "le") -> bytes:
    """The same for a literal, on the driver."""
    if isinstance(value, str):
        return value.encode()
    if not 0 <= value <= MAX_U64:
        raise ValueError(f"number out of range: {value}")
    return value.to_bytes(8, "little" if order == "le" else "big")


def lit_value(value: str | int, kind: T.DataType) -> Column:
    """A literal of the column's type; by way of text, as numbers can be too large for a long."""
    return F.lit(str(value)).cast(kind)


def lit_key(raw: bytes) -> Column:
    """A binary literal (foldable, so that it is pushed to the scan)."""
    return F.lit(bytearray(raw))


def hex_bound(text: str) -> bytes | None:
    """A shard boundary: lower-case hex, or - for an open end."""
    if text == "-":
        return None
    if len(text) % 2:
        raise ValueError(f"invalid hex range boundary: {text}")
    if bad := [c for c in text if c not in "0123456789abcdef"]:
        raise ValueError(f"invalid hex char: {bad[0]}")
    return bytes.fromhex(text)


def key_bits(key: Column) -> Column:
    """A key as a string of 0 and 1, the most significant bit of each byte first."""
    digits = F.split(F.hex(key), "")
    return F.array_join(F.transform(digits, lambda d: F.when(d == "", "").otherwise(F.lpad(F.conv(d, 16, 2), 4, "0"))), "")


def bits_to_key(bits: Column) -> Column:
    """The bytes of a string of bits whose length is a multiple of eight."""
    nibbles = F.transform(F.sequence(F.lit(0), F.floor(F.length(bits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16))
    return F.unhex(F.when(F.length(bits) > 0, F.array_join(nibbles, "")).otherwise(""))


def floor_log2(n: Column) -> Column:
    """0 for n up to 1, else the exact integer logarithm."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n)) - 1).cast("int")


def row_text(*cols: Column) -> Column:
    """A row as the command language prints it."""
    return F.concat_ws(" | ", *[c.cast("string") for c in cols])
