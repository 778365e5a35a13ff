"""Rounding that agrees between engines, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column | str, digits: int) -> Column:
    """x rounded to ``digits`` decimals, ties upward, in plain double arithmetic: any engine that computes floor(x * 10^d + 0.5) / 10^d agrees."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * float(10**digits) + 0.5).cast("double") / float(10**digits)


def half_up_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits}::DOUBLE + 0.5)::DOUBLE / 1e{digits}::DOUBLE)"


def plain_number(x: Column) -> Column:
    """25.0 as 25, 2.5 as 2.5; large numbers without exponents."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).when(x.isNotNull(), F.regexp_replace(F.format_string("%.6f", x), "0+$", ""))


def two_figures(x: Column) -> Column:
    """Rounded to two significant figures, ties to even; 0 stays 0."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit)
