"""Periodic-table functions of the atomic number, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The noble gases' atomic numbers close the periods.
CLOSED = (2, 10, 18, 36, 54, 86, 118)


def period(z: Column) -> Column:
    """1 to 7, missing below 1 and above 118."""
    out = F.when(z < 1, F.lit(None).cast("int"))
    return reduce(lambda e, kp: e.when(z <= kp[1], F.lit(kp[0])), enumerate(CLOSED, 1), out)


def _place(z: Column) -> tuple[Column, Column]:
    """Place in the period from 1 on, and the period's length."""
    before = reduce(lambda e, c: e.when(z > c, F.lit(c)), reversed(CLOSED[:-1]), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    after = reduce(lambda e, c: e.when(z <= c, F.lit(c)), CLOSED, F.when(F.lit(False), F.lit(0)))
    return z - before, after - before


def group(z: Column) -> Column:
    """IUPAC group as text; "none" for lanthanides and actinides and outside the table."""
    place, length = _place(z)
    number = F.when(z == 2, 18).when(place <= 2, place).when(length == 8, place + 10).when(length == 18, place).when(place >= 18, place - 14)
    return F.when((z >= 1) & (z <= CLOSED[-1]) & number.isNotNull(), number.cast("string")).otherwise("none")


def block(z: Column) -> Column:
    """s, p, d or f by the place in the period; missing outside the table."""
    place, length = _place(z)
    inside = (z >= 1) & (z <= CLOSED[-1])
    return F.when(inside, F.when((place <= 2) | (z == 2), "s").when(place > length - 6, "p").when((length == 32) & (place <= 16), "f").otherwise("d"))


def half_steps(x: Column) -> Column:
    """A value rounded to the next half, ties to even, with one decimal."""
    return F.format_string("%.1f", F.bround(x * 2, 0) / 2)


def canonical_key(text: Column, mirror: Column) -> Column:
    """The smaller of a canonical text and that of its mirror image."""
    return F.least(text, mirror)


def subset_of(text: Column, prefixes: dict[str, str]) -> Column:
    """The subset that a text's prefix stands for; a text with none of the prefixes is an error."""
    out = None
    for prefix, name in prefixes.items():
        out = F.when(text.startswith(prefix), F.lit(name)) if out is None else out.when(text.startswith(prefix), F.lit(name))
    wrong = F.raise_error(F.concat(F.lit("no subset for "), text)).cast("string")
    return wrong if out is None else out.otherwise(wrong)
