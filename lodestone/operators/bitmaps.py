"""Bitmaps as binary values; bit 0 is the highest bit of the first byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import Refused


def _byte(b: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int")


def _bytes(b: Column) -> Column:
    """Array of the byte values."""
    n = F.octet_length(b)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _byte(b, i)))


def _binary(a: Column) -> Column:
    return F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def get_bit(b: Column, at: int) -> Column:
    i = F.lit(at // 8)
    return F.when(F.octet_length(b) > at // 8, F.shiftright(_byte(b, i), 7 - at % 8).bitwiseAND(F.lit(1))).otherwise(F.lit(0)).cast("int")


def set_bit(b: Column, at: int, bit: int) -> Column:
    whole = F.rpad(F.coalesce(b, F.lit(b"")), F.greatest(F.octet_length(F.coalesce(b, F.lit(b""))), F.lit(at // 8 + 1)), F.lit(b"\0"))
    mask = 1 << (7 - at % 8)
    old = _byte(whole, F.lit(at // 8))
    new = old.bitwiseOR(F.lit(mask)) if bit else old.bitwiseAND(F.lit(255 - mask))
    return F.concat(F.substring(whole, F.lit(1), F.lit(at // 8)), F.unhex(F.lpad(F.hex(new.cast("long")), 2, "0")), F.substring(whole, F.lit(at // 8 + 2), F.lit(2147483647)))


def bit_count(b: Column, start: int = 0, stop: int = -1) -> Column:
    """Set bits in bytes start..stop, negative from the end."""
    n = F.octet_length(b)
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    part = F.substring(b, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return F.aggregate(_bytes(part), F.lit(0), lambda s, x: s + F.bit_count(x)).cast("long")


def bit_pos(b: Column, bit: int) -> Column:
    """Place of the first such bit; -1 if there is none (for 0, the first one past the end)."""
    n = F.octet_length(b)
    text = F.array_join(F.transform(_bytes(b), lambda x: F.lpad(F.bin(x.cast("long")), 8, "0")), "")
    at = F.instr(text, F.lit(str(bit))) - 1
    return (F.when(at < 0, n * 8).otherwise(at) if bit == 0 else at).cast("long")


def bit_op(op: str, *bs: Column) -> Column:
    """AND, OR, XOR (shorter values padded with zeros) or NOT."""
    if op == "NOT":
        if len(bs) != 1:
            raise Refused("BITOP NOT takes one value")
        return _binary(F.transform(_bytes(bs[0]), lambda x: F.lit(255) - x))
    if op not in ("AND", "OR", "XOR"):
        raise Refused(f"BITOP {op}")
    n = F.greatest(*[F.octet_length(b) for b in bs]) if len(bs) > 1 else F.octet_length(bs[0])
    out = _bytes(F.rpad(bs[0], n, F.lit(b"\0")))
    for b in bs[1:]:
        out = F.zip_with(out, _bytes(F.rpad(b, n, F.lit(b"\0"))), {"AND": lambda x, y: x.bitwiseAND(y), "OR": lambda x, y: x.bitwiseOR(y), "XOR": lambda x, y: x.bitwiseXOR(y)}[op])
    return _binary(out)
