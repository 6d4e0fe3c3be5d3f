"""Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def clean(c: Column) -> Column:
    """NaN becomes NULL and -0.0 becomes 0.0."""
    return F.nanvl(c, F.lit(None).cast("double")) + F.lit(0.0)


def zero_fill(c: Column) -> Column:
    """NULL, NaN become 0."""
    return F.coalesce(clean(c), F.lit(0.0))


def sigmoid(x: Column, a: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-a * x))


def sigmoid_derivative(x: Column, a: float = 1.0) -> Column:
    """s(1-s); the slope ``a`` is applied inside the sigmoid only."""
    s = sigmoid(x, a)
    return s * (1 - s)


def gain(rating: Column) -> Column:
    """Exponential gain 10^r - 1."""
    return F.pow(F.lit(10.0), rating) - 1


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def recode_label(c: Column) -> Column:
    """yes/no and numeric text to an integer label; other text becomes NULL."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text == "yes", 1)
        .when(text == "no", 0)
        .otherwise(text.try_cast("double").cast("int"))
    )


def flag(condition: Column) -> Column:
    return condition.cast("int")


def is_flat(std: Column, mean: Column) -> Column:
    """True when the spread is rounding noise, so shape statistics are undefined."""
    return std <= 1e-12 * F.greatest(F.lit(1.0), F.abs(mean))


def widen(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Histogram range; a constant column gets one unit around its value."""
    same = lo == hi
    return F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi)


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of ``x`` among equal-width bins, right edge included in the last bin.

    The plain floor form misplaces values that sit on an edge; one comparison with the edge on
    either side repairs it.
    """
    width = (hi - lo) / float(bins)
    first = F.least(F.floor((x - lo) * (float(bins) / (hi - lo))).cast("int"), F.lit(bins - 1))
    return (
        F.when(x < first * width + lo, first - 1)
        .when((x >= (first + 1) * width + lo) & (first < bins - 1), first + 1)
        .otherwise(first)
    )


def bins_of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """``bin_index`` for a matrix with one range per column, clipped to the range."""
    width = (hi - lo) / bins
    first = x - lo
    first *= bins / (hi - lo)
    np.floor(first, out=first)
    np.minimum(first, bins - 1, out=first)
    edge = first * width
    edge += lo
    first -= x < edge
    np.add(first, 1, out=edge)
    edge *= width
    edge += lo
    up = x >= edge
    up &= first < bins - 1
    first += up
    return np.clip(first.astype(int), 0, bins - 1)


def normality_p(n: Column, skew: Column, kurt: Column) -> Column:
    """p of the omnibus normality test from sample size, population skewness and excess kurtosis.

    D'Agostino (1970) for skewness, Anscombe and Glynn (1983) for kurtosis; NULL below 8 rows.
    """
    n = n.cast("double")
    n = F.when(n >= 8, n)
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = (
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / F.sqrt(variance)
    s = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    q = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(q) * F.cbrt(F.try_divide(1 - 2 / a, F.abs(q)))
    z_kurt = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    return F.exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2)


# The six summary parts, in the order they are stored.
SUMMARY_PARTS = ("min", "max", "mean", "std", "skewness", "kurtosis")


# Doublings between neighbouring scales of ``summaries``: fourth powers of values on one scale stay finite.
_SPAN = 64
# Scale of zeros, below that of every other number.
_NOTHING = -100


def _doubled(c: Column, steps: Column) -> Column:
    """``c`` times 2 to the ``steps`` spans, in halves that neither overflow nor vanish on the way."""
    half = F.pow(F.lit(2.0), steps * (_SPAN // 2))
    return c * half * half


def summaries(
    df: DataFrame,
    blocks: Sequence[str],
    parts: Sequence[str] = SUMMARY_PARTS,
    key: str = "dataset_id",
) -> DataFrame:
    """Six-number summaries of columns per dataset, long: (dataset_id, name, value).

    ``df`` has one row per feature, pair, bin or tree. NULLs are ignored, moments are population
    moments, and a name is block_part. Values of like size share a scale, on which central moments
    neither overflow nor vanish; they are summed per scale on the map side, so a dataset of any
    width is spread over all tasks, and the few scales of a block merge by the rule for central
    moments of a union (Pebay 2008).
    """
    entries = [F.struct(F.lit(b).alias("block"), F.col(b).cast("double").alias("v")) for b in blocks]
    values = df.select(key, F.inline(F.array(*entries))).withColumn("v", clean(F.col("v")))
    most = F.lit(1024.0 / _SPAN)  # infinite values stand with the largest
    scale = F.when(F.abs("v") > 0, F.floor(F.least(F.log2(F.abs("v")) / _SPAN, most))).otherwise(_NOTHING).cast("int")
    scaled = values.withColumn("_at", scale).withColumn(
        "_s", F.when(F.col("v") == 0, 0.0).otherwise(_doubled(F.col("v"), -F.col("_at")))
    )
    each = scaled.groupBy(key, "block", "_at").agg(
        F.count("v").cast("double").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.coalesce(F.avg("_s"), F.lit(0.0)).alias("m1"), F.coalesce(F.var_pop("_s"), F.lit(0.0)).alias("var"), F.skewness("_s").alias("skew"), F.kurtosis("_s").alias("kurt"),
    )
    varies = F.col("var") > 0
    held = F.struct(
        F.col("_at").alias("at"), F.col("n").alias("n"), F.col("m1").alias("m1"), (F.col("var") * F.col("n")).alias("m2"),
        F.when(varies, F.col("skew") * F.col("n") * F.col("var") * F.sqrt("var")).otherwise(0.0).alias("m3"),
        F.when(varies, (F.col("kurt") + 3) * F.col("n") * F.col("var") * F.col("var")).otherwise(0.0).alias("m4"),
    )
    merged = each.groupBy(key, "block").agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("_n"), F.max("_at").alias("_top"),
        F.collect_list(held).alias("_b"),  # one entry per scale, about 35 at most
    )

    def total(of) -> Column:
        return F.aggregate(F.transform("_b", of), F.lit(0.0), lambda a, x: a + x)

    def share(b: Column, power: int) -> Column:
        return F.pow(F.lit(2.0), (b["at"] - F.col("_top")) * (_SPAN * power))

    def moved(b: Column) -> Column:
        return b["m1"] * share(b, 1) - F.col("_m1")

    merged = merged.withColumn("_m1", F.try_divide(total(lambda b: b["n"] * b["m1"] * share(b, 1)), F.col("_n")))
    merged = merged.withColumns({
        "_m2": total(lambda b: b["m2"] * share(b, 2) + b["n"] * moved(b) * moved(b)),
        "_m3": total(lambda b: b["m3"] * share(b, 3) + 3 * moved(b) * b["m2"] * share(b, 2) + b["n"] * F.pow(moved(b), 3)),
        "_m4": total(
            lambda b: b["m4"] * share(b, 4) + 4 * moved(b) * b["m3"] * share(b, 3)
            + 6 * moved(b) * moved(b) * b["m2"] * share(b, 2) + b["n"] * F.pow(moved(b), 4)
        ),
    })
    variance = F.try_divide(F.col("_m2"), F.col("_n"))
    top = F.when(F.col("_top") == _NOTHING, 0).otherwise(F.col("_top"))
    merged = merged.withColumns({"mean": _doubled(F.col("_m1"), top), "std": _doubled(F.sqrt(variance), top)})
    flat = is_flat(F.col("std"), F.col("mean"))
    merged = merged.withColumns({
        "skewness": F.when(~flat, F.try_divide(F.try_divide(F.col("_m3"), F.col("_n")), variance * F.sqrt(variance))),
        "kurtosis": F.when(~flat, F.try_divide(F.try_divide(F.col("_m4"), F.col("_n")), variance * variance) - 3),
    })
    out = [
        F.struct(F.concat("block", F.lit(f"_{p}")).alias("name"), F.col(p).alias("value"))
        for p in parts
    ]
    return merged.select(key, F.inline(F.array(*out)))
