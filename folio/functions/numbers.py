"""Numbers: lengths, and rounding as IEEE values have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English metric units in a millimetre, a centimetre and a point; twentieths in a point.
EMU_MM, EMU_CM, EMU_PT, TWIP_PT = 36000, 360000, 12700, 20


def tenths(x: Column) -> Column:
    """The exact binary value of x in whole tenths, halves to the even one.

    Twenty times x is 16x + 4x, both exact; what their sum loses is known exactly too, so it decides on which
    side of a half the value lies, as decimals of its shortest notation can't."""
    big, small = x * 16, x * 4
    total = big + small
    lost = small - (total - big)
    low = F.floor(total / 2)
    over = (total - low * 2 - 1) + lost  # beyond the half
    return low + F.when(over > 0, 1).when(over < 0, 0).otherwise(F.pmod(low, F.lit(2)))


def rounded(x: Column) -> Column:
    """x to one digit, as IEEE values are rounded."""
    return tenths(x) / 10.0


def emu_to_mm(c: Column) -> Column:
    return F.bround(c / EMU_MM, 2)


def emu_to_cm(c: Column) -> Column:
    return F.bround(c / EMU_CM, 2)


def mm_to_emu(c: Column) -> Column:
    return (c * EMU_MM).cast("long")


def cm_to_emu(c: Column) -> Column:
    return (c * EMU_CM).cast("long")


def pt_to_emu(c: Column) -> Column:
    return (c * EMU_PT).cast("long")


def page_estimate(chars: Column, per_page: int = 2200) -> Column:
    """Pages of so many characters, at least one; halves go to the even page."""
    return F.greatest(F.lit(1), F.bround(chars.cast("double") / per_page, 0).cast("int"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
