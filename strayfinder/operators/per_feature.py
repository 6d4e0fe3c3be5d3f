"""Statistics of each feature, and their six-number summaries across features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import flag, is_flat, normality_p, summaries
from strayfinder.operators.pooled import value_counts
from strayfinder.session import sized
from strayfinder.sources.datasets import cells

MOMENT_ORDERS = range(5, 11)

# Blocks in vector order: the first group precedes the pair blocks, the others follow them.
FEATURE_BLOCKS = (
    "normality_p", "is_normal_5", "is_normal_1", "moment_5", "moment_6", "moment_7", "moment_8",
    "moment_9", "moment_10", "skewness", "kurtosis", "sparsity", "entropy",
)


def feature_base(sample_df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Count, range, shape and central moments of every feature, in two scans.

    The first scan finds count, mean and range; the second averages powers of the distance from
    the mean, which is accurate far from zero and needs plain sums only. Skewness and kurtosis of a
    constant feature are NULL. ``n_rows`` counts missing values too, and rows without features
    appear under a NULL ``f_idx``, so ``validate_base`` needs no other scan. Given outer
    ``value_counts``, both scans read these, never more rows than there are cells.
    """
    keys = ["dataset_id", "f_idx"]
    v = F.col("value")
    if counts is None:
        outer = sample_df.select("dataset_id", F.posexplode_outer("features").alias("f_idx", "value"))
        inner, n, n_rows, mean = cells(sample_df), F.count(v), F.count(F.lit(1)), F.avg
    else:
        outer = inner = counts
        n_rows, c = F.sum("c"), F.when(v.isNotNull(), F.col("c"))
        n = F.coalesce(F.sum(c), F.lit(0))

        def mean(of):
            return F.try_divide(F.sum(of * c), F.sum(c))

    first = sized(
        outer.groupBy(*keys).agg(
            n.alias("n"),
            mean(v).alias("mean"),
            F.min(v).alias("lo"),
            F.max(v).alias("hi"),
            n_rows.alias("n_rows"),
        )
    )
    d = v - F.col("mean")
    powers = {2: d * d, 3: d * d * d}
    powers[4] = powers[2] * powers[2]
    for k in range(5, 11):
        powers[k] = powers[k // 2] * powers[k - k // 2]
    second = (
        inner.join(first.select(*keys, "mean"), keys)
        .groupBy(*keys)
        .agg(*[mean(p).alias(f"moment_{k}") for k, p in powers.items()])
    )
    var, std = F.col("moment_2"), F.sqrt("moment_2")
    varies = ~is_flat(std, F.col("mean"))
    return first.join(second, keys, "left").select(
        *keys, "n", "mean", var.alias("var"), std.alias("std"), "lo", "hi",
        F.when(varies, F.col("moment_3") / F.pow(std, F.lit(3))).alias("skewness"),
        F.when(varies, F.col("moment_4") / (var * var) - 3).alias("kurtosis"),
        *[f"moment_{k}" for k in MOMENT_ORDERS],
        "n_rows",
    )


def validate_base(base: DataFrame) -> DataFrame:
    """Raise when a dataset is ragged or has missing or infinite cells, judged by ``base`` alone.

    NaN is the largest value in Spark's order, so it shows in the maximum.
    """
    infinite = float("inf")
    bad = (
        F.col("f_idx").isNull()
        | (F.col("n") != F.col("n_rows"))
        | F.isnan("hi")
        | (F.col("hi") == infinite)
        | (F.col("lo") == -infinite)
    )
    report = base.groupBy("dataset_id").agg(
        F.count_if(bad).alias("bad_features"),
        F.min("n_rows").alias("fewest"),
        F.max("n_rows").alias("most"),
    )
    wrong = report.where((F.col("bad_features") > 0) | (F.col("fewest") != F.col("most")))
    first = wrong.orderBy("dataset_id").limit(3).collect()
    if first:
        raise ValueError(f"invalid datasets: {[r.asDict() for r in first]}")
    return base


def count_features(counts: DataFrame) -> DataFrame:
    """Distinct share and natural-log entropy over n, from value counts."""
    c = F.col("c").cast("double")
    n = F.sum(c)
    return counts.groupBy("dataset_id", "f_idx").agg(
        (F.count(F.lit(1)) / n).alias("sparsity"),
        ((F.log(n) - F.sum(c * F.log(c)) / n) / n).alias("entropy"),
    )


def normality(base: DataFrame) -> DataFrame:
    """p of the normality test and its flags; a flag of 1 means normality is rejected."""
    p = normality_p(F.col("n"), F.col("skewness"), F.col("kurtosis"))
    return base.withColumn("normality_p", p).select(
        "*",
        flag(F.coalesce(F.col("normality_p") < 0.05, F.lit(False))).alias("is_normal_5"),
        flag(F.coalesce(F.col("normality_p") < 0.01, F.lit(False))).alias("is_normal_1"),
    )


def feature_stats(
    sample_df: DataFrame, base: DataFrame | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """All per-feature values, one row per (dataset, feature)."""
    base = sized(feature_base(sample_df)) if base is None else base
    counts = value_counts(sample_df) if counts is None else counts
    keys = ["dataset_id", "f_idx"]
    return normality(base).join(count_features(counts), keys)


def feature_summaries(stats: DataFrame, blocks: tuple[str, ...] = FEATURE_BLOCKS) -> DataFrame:
    """Six-number summaries across the features of each dataset."""
    return summaries(stats, blocks)
