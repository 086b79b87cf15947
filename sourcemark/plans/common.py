"""Shared pieces of the registered queries: table access and SQL fragments for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcemark.sources.tables import read_driver_table as table

__all__ = ["DataFrame", "SparkSession", "table", "sql_round", "WS"]

# Unicode white space as an RE2 class, for the comparison SQL.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_round(value: str, digits: int) -> str:
    """SQL for rounding the stored binary value half to even, in whole-number arithmetic."""
    unit = 2**90
    scaled = f"((({value}) - floor({value})) * pow(2.0, 90))::HUGEINT * {10**digits}"
    quotient, rest = f"(({scaled}) // {unit}::HUGEINT)", f"(({scaled}) % {unit}::HUGEINT)"
    up = (
        f"(CASE WHEN {rest} * 2 > {unit}::HUGEINT OR ({rest} * 2 = {unit}::HUGEINT AND {quotient} % 2 = 1) "
        "THEN 1 ELSE 0 END)"
    )
    return f"((floor({value})::HUGEINT * {10**digits} + {quotient} + {up})::DOUBLE / {10**digits}.0)"
