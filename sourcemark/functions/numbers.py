"""Numeric columns whose last digit is part of the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How near a tie a scaled fraction must be before the stored bits are looked at.
_NEAR = 1e-6


def round_exact(value: Column, digits: int) -> Column:
    """Round to ``digits`` places, half to even, judging the *stored binary* value.

    ``bround`` rounds the shortest decimal spelling, so 0.00625 (stored a little above the
    tie) goes down there and up here. Only values next to a tie take the careful branches.
    """
    scale = 10**digits
    # Most values need no care: the product is exact (few binary places), or its error is far smaller than the way to a tie.
    product = value * F.lit(float(scale))
    whole_bits = value * F.lit(1024.0)
    exact = (F.abs(value) < 2.0**43 / scale) & (F.rint(whole_bits) == whole_bits)
    far = (F.abs(value) < 1e9 / scale) & (F.abs(product - F.floor(product) - 0.5) > _NEAR)
    return F.when(exact | far, F.rint(product) / F.lit(float(scale))).otherwise(_with_care(value, scale, digits))


def _with_care(value: Column, scale: int, digits: int) -> Column:
    magnitude = F.abs(value)
    whole = F.floor(magnitude)
    fraction = magnitude - whole
    scaled = fraction * F.lit(float(scale))
    low = F.floor(scaled)
    tie = (low + F.lit(0.5)) / F.lit(float(scale))
    up = (
        F.when(F.abs(scaled - low - 0.5) > _NEAR, scaled - low > 0.5)
        .when(fraction != tie, fraction > tie)
        # The tie is a binary fraction, so it is stored exactly: half to even.
        .when((low * 2 + 1) % 5**digits == 0, low % 2 == 1)
        .otherwise(_above_tie(fraction, low, scale))
    )
    result = (whole * scale + low + up.cast("bigint")) / F.lit(float(scale))
    return F.signum(value) * result


def _above_tie(fraction: Column, low: Column, scale: int) -> Column:
    """Whether the stored fraction lies above (low + 1/2) / scale, in whole numbers.

    Scaling by a power of two is exact; the power is chosen so that no mantissa bit is lost.
    """

    def above(bits: int) -> Column:
        stored = (fraction * F.lit(2.0**bits)).cast("bigint").cast("decimal(19,0)")
        unit = F.lit(str(2**bits)).cast("decimal(25,0)")
        return stored * F.lit(2 * scale).cast("decimal(9,0)") > unit * (low * 2 + 1).cast("decimal(9,0)")

    return F.when(fraction >= 2.0**-9, above(62)).when(fraction >= 2.0**-18, above(71)).otherwise(above(80))


def rate(part: Column, total: Column) -> Column:
    """part / total, null when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), total.cast("double"))
