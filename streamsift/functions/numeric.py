"""Scalar helpers shared by operators and by the SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Offset of the comparison grid: values computed from short decimals
# (means of prices over 2, 4, 8 rows...) often sit exactly on a half-way
# point of a decimal grid, where a last-bit difference between two engines
# flips the rounding.  Shifting the grid by an irrational fraction keeps
# exact decimals away from the cut points.
GRID_OFFSET = 0.6180339887498949


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Comparison rounding with plain IEEE arithmetic:
    ``floor(x*10^d + offset) / 10^d``.

    The same expression is written in the DuckDB oracles (``rnd_sql``), so both
    engines produce the identical double for identical inputs.  Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = 10.0 ** digits
    return (F.floor(c * F.lit(scale) + F.lit(GRID_OFFSET)).cast("double") / F.lit(scale))


def rnd_sql(expr: str, digits: int = 6) -> str:
    scale = 10.0 ** digits
    return f"(CAST(floor(({expr}) * {scale!r} + {GRID_OFFSET!r}) AS DOUBLE) / {scale!r})"


def safe_div(num: Column, den: Column, default=None) -> Column:
    """num/den, ``default`` (null when None) where den is 0 or null; ANSI-safe."""
    out = F.when(den.isNotNull() & (den != 0), num / den)
    return out if default is None else out.otherwise(default)


def nan_to_num(c: Column) -> Column:
    """numpy.nan_to_num: NaN -> 0, +inf -> largest double, -inf -> lowest."""
    big = 1.7976931348623157e308
    return (F.when(F.isnan(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(big))
            .when(c == F.lit(float("-inf")), F.lit(-big))
            .otherwise(c))


def epoch_micros(name: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ column (wall clock),
    independent of the session time zone; a cast to TIMESTAMP would apply
    the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name}` AS TIMESTAMP_NTZ))")
