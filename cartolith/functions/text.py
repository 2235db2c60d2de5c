"""Byte-wise text functions: only ASCII letters fold, all else must match exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))


def ascii_fold(c: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _UPPER.lower()))


def ascii_icontains(hay: Column, needle: str) -> Column:
    """Whether hay holds needle, A to Z in either case; an empty needle is in everything."""
    return F.lit(True) if not needle else ascii_fold(hay).contains(fold_text(needle))


def trigrams(c: Column) -> Column:
    """The distinct three-byte windows of the folded UTF-8 bytes as 24-bit numbers, ascending; none below three bytes."""
    hexed = F.hex(F.encode(ascii_fold(c), "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(6)), 16, 10).cast("int"))
    return F.when(n >= 3, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<int>"))


def text_trigrams(s: str) -> list[int]:
    b = fold_text(s).encode()
    return sorted({int.from_bytes(b[i : i + 3], "big") for i in range(len(b) - 2)})


def label(value_of: dict[str, Column], keys: tuple[str, ...]) -> Column:
    """What to call an element: its name, else the first of keys it has a value of."""
    return F.coalesce(value_of["name"], *(F.concat(F.lit(k + "="), value_of[k]) for k in keys), F.lit("(no descriptive tags)"))
