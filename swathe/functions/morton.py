"""Morton codes as bit operations on longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _steps(bits: int, gap: int) -> list[tuple[int, int]]:
    """(shift, mask) steps that spread ``bits`` bits to every ``gap``-th: groups of bits are halved until each is one."""
    out, size = [], 1 << (bits - 1).bit_length() >> 1
    while size:
        mask = sum(1 << (k // size * size * gap + k % size) for k in range(bits))
        out.append((size * (gap - 1), mask))
        size //= 2
    return out


SPREAD2, SPREAD3 = _steps(16, 2), _steps(21, 3)


def _spread(v: Column, steps: list[tuple[int, int]]) -> Column:
    v = v.cast("long")
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column, steps: list[tuple[int, int]], full: int) -> Column:
    masks = [m for _, m in steps]
    v = v.bitwiseAND(F.lit(masks[-1]))
    for (shift, _), mask in zip(reversed(steps), [*reversed(masks[:-1]), full], strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def scaled(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """A value's cell among 2**bits between lo and hi; the top belongs to the last cell."""
    n = 1 << bits
    return F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1)).cast("long")


def morton2(x: Column, y: Column) -> Column:
    """x on the higher of each two bits; 16 bits each."""
    return F.shiftleft(_spread(x, SPREAD2), 1).bitwiseOR(_spread(y, SPREAD2))


def unmorton2(code: Column) -> tuple[Column, Column]:
    return _gather(F.shiftright(code, 1), SPREAD2, 0xFFFF), _gather(code, SPREAD2, 0xFFFF)


def morton3(x: Column, y: Column, z: Column) -> Column:
    """x highest; 21 bits each, 63 in all."""
    return F.shiftleft(_spread(x, SPREAD3), 2).bitwiseOR(F.shiftleft(_spread(y, SPREAD3), 1)).bitwiseOR(_spread(z, SPREAD3))


def unmorton3(code: Column) -> tuple[Column, Column, Column]:
    return tuple(_gather(F.shiftright(code, s) if s else code, SPREAD3, 0x1FFFFF) for s in (2, 1, 0))


def morton30(x: Column, y: Column, z: Column) -> Column:
    """Of three values between 0 and 1, in 1024 cells each, clamped at both ends."""
    cell = lambda v: F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(v * 1024))).cast("long")
    return morton3(cell(x), cell(y), cell(z))


def common_upper_bits(a: Column, b: Column) -> Column:
    """Leading bits that two non-negative longs share, of 64."""
    return F.when(a == b, 64).otherwise(64 - F.length(F.bin(a.bitwiseXOR(b)))).cast("long")
