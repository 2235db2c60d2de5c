"""Z-order cell codes as column expressions.

The plane is cut into square cells of 360 / 2**level degrees; a cell's code
interleaves the bits of its column and row. A cell of a coarser level is the
range of all finer codes that share its prefix, so that a cover by cells is a
cover by code ranges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 28


def _spread_bits(n: int) -> int:
    return sum(((n >> i) & 1) << (2 * i) for i in range(4))


def spread(x: Column, bits: int = 31) -> Column:
    """The bits of x, below 2**bits, with a zero bit after each."""
    # one foldable expression: the optimizer turns it into a constant array
    tab = F.split(F.lit(",".join(str(_spread_bits(n)) for n in range(16))), ",").cast("array<bigint>")
    out = None
    for k in range(-(-bits // 4)):
        part = F.get(tab, F.shiftright(x, 4 * k).bitwiseAND(15).cast("int"))
        part = F.shiftleft(part, 8 * k) if k else part
        out = part if out is None else out.bitwiseOR(part)
    return out


def weave(sx: Column, sy: Column) -> Column:
    """Z-order code of a column and a row whose bits are spread already."""
    return F.shiftleft(sx, 1).bitwiseOR(sy)


def width(level: int) -> float:
    return 360.0 / (1 << level)


def column_of(lon: Column, cell: Column | float) -> Column:
    """Column number of a longitude; 0 for anything west of -180."""
    return F.greatest(F.floor((lon + 180.0) / cell), F.lit(0).cast("bigint"))


def row_of(lat: Column, cell: Column | float) -> Column:
    return F.greatest(F.floor((lat + 90.0) / cell), F.lit(0).cast("bigint"))


def interleave(x: Column, y: Column, bits: int = 31) -> Column:
    """Z-order code of column x and row y, both below 2**bits."""
    return weave(spread(x, bits), spread(y, bits))


def cell(lon: Column, lat: Column, level: int) -> Column:
    w = width(level)
    return interleave(column_of(lon, w), row_of(lat, w), level + 1)


def prefix(code: Column, level: int, to: int) -> Column:
    """Code at level `to` of the cell that holds a cell of the finer `level`."""
    return F.shiftright(code, 2 * (level - to))


def fitting_level(extent: Column, across: int = 4, step: int = 2) -> Column:
    """The coarsest multiple of step at which extent degrees span `across` cells or more."""
    lv = F.ceil(F.log2(F.lit(360.0 * across) / F.greatest(extent, F.lit(1e-9))) / step).cast("int") * step
    return F.least(F.greatest(lv, F.lit(0)), F.lit(MAX_LEVEL))
