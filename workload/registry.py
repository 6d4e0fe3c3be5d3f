"""Registration of queries and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NUDGE = 1.000000000001


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


FLOOR = 1e-9


def digits(c: Column | str, floor: float = FLOOR) -> Column:
    """Eight significant digits, 0 below ``floor``: hides the order of floating-point sums.

    Probabilities and densities, whose small values matter, take a floor of TINY.

    The factor keeps decimals that end in an exact 5 from being rounded differently by two engines.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    text = F.format_string("%.7e", c * NUDGE)
    return F.when(F.abs(c) < floor, 0.0).when(
        c.isNotNull() & ~F.isnan(c), text.cast("double") + F.lit(0.0)
    )


TINY = 1e-290


def rounded(df: DataFrame, *columns: str, floor: float = FLOOR) -> DataFrame:
    return df.select(
        *[digits(c, floor).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def r(expression: str, floor: float = FLOOR) -> str:
    """The SQL side of ``digits``."""
    x = f"CAST({expression} AS DOUBLE)"
    return (
        f"CASE WHEN abs({x}) < {floor!r} THEN 0.0 "
        f"ELSE CAST(printf('%.7e', {x} * CAST({NUDGE!r} AS DOUBLE)) AS DOUBLE) + 0.0 END"
    )


def rs(*columns: str, table: str = "") -> str:
    """``digits`` of several columns under their own names."""
    prefix = f"{table}." if table else ""
    return ", ".join(f"{r(prefix + c)} AS {c}" for c in columns)
