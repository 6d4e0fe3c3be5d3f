"""Statistics of all cells of a dataset taken together (29 of the 200 meta-features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayfinder.session import durable, running_sums, sized
from strayfinder.sources.datasets import cells

# Percentile arguments (fixed values). They are read as percents, so "q25" is the 0.25th percent;
# ``quantile_scale=1`` reads them as the usual quartiles and first/last percent.
PERCENTILES = {"q1": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99}

POOLED_NAMES = (
    "n_samples", "n_features", "sample_mean", "sample_median", "sample_var", "sample_min",
    "sample_max", "sample_std", "q1", "q25", "q75", "q99", "iqr", "normalized_mean",
    "normalized_median", "sample_range", "sample_gini", "med_abs_dev", "avg_abs_dev",
    "quant_coeff_disp", "coeff_var", "percent_outliers_15iqr", "percent_outliers_3iqr",
    "percent_outliers_1_99", "percent_outliers_3std", "has_outliers_15iqr", "has_outliers_3iqr",
    "has_outliers_1_99", "has_outliers_3std",
)


def pooled_base(sample_df: DataFrame) -> DataFrame:
    """Counts and moments per dataset in one scan with map-side partial aggregation."""
    v = F.col("value")
    return (
        cells(sample_df)
        .groupBy("dataset_id")
        .agg(
            F.count_if(F.col("f_idx") == 0).alias("n_samples"),
            (F.max("f_idx") + 1).cast("bigint").alias("n_features"),
            F.count(v).alias("n_cells"),
            F.avg(v).alias("sample_mean"),
            F.var_pop(v).alias("sample_var"),
            F.min(v).alias("sample_min"),
            F.max(v).alias("sample_max"),
            F.stddev_pop(v).alias("sample_std"),
        )
    )


def merged_base(features: DataFrame) -> DataFrame:
    """The table of ``pooled_base`` from per-feature statistics, without a scan of the data."""
    n = F.col("n").cast("double")
    mean = F.try_divide(F.sum(n * F.col("mean")), F.sum(n))
    # spread within features plus spread between their means, about the mean of the means
    centre = F.avg("mean").over(Window.partitionBy("dataset_id"))
    shifted = features.withColumn("_d", F.col("mean") - centre)
    between = F.sum(n * F.col("_d")) / F.sum(n)
    var = F.sum(n * (F.col("var") + F.col("_d") * F.col("_d"))) / F.sum(n) - between * between
    return (
        shifted.groupBy("dataset_id")
        .agg(
            F.max("n").alias("n_samples"),
            F.count(F.lit(1)).alias("n_features"),
            F.sum("n").alias("n_cells"),
            mean.alias("sample_mean"),
            var.alias("sample_var"),
            F.min("lo").alias("sample_min"),
            F.max("hi").alias("sample_max"),
        )
        .withColumn("sample_std", F.sqrt(F.greatest(F.col("sample_var"), F.lit(0.0))))
    )


def value_counts(sample_df: DataFrame, outer: bool = False) -> DataFrame:
    """(dataset_id, f_idx, value, c): how often each value occurs in each feature.

    With ``outer``, rows without features count under a NULL ``f_idx``.
    """
    values = F.posexplode_outer("features").alias("f_idx", "value")
    found = sample_df.select("dataset_id", values) if outer else cells(sample_df)
    return (
        found.groupBy("dataset_id", "f_idx", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def pooled_counts(sample_df: DataFrame) -> DataFrame:
    """(dataset_id, value, c) over all features."""
    return cells(sample_df).groupBy("dataset_id", "value").agg(F.count(F.lit(1)).alias("c"))


def _at_rank(rank: Column) -> Column:
    """Aggregate: the value holding 0-based ``rank`` in sorted order, from running counts."""
    here = (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    return F.max(F.when(here, F.col("value")))


def exact_quantiles(
    ranked: DataFrame, total: str, probabilities: dict[str, float], extra: list[Column] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per dataset from value counts with running totals."""
    low, high, parts = {}, {}, []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col(total) - 1)
        low[name], high[name] = f"_lo_{name}", f"_hi_{name}"
        parts.append(_at_rank(F.floor(position)).alias(low[name]))
        parts.append(_at_rank(F.ceil(position)).alias(high[name]))
    out = ranked.groupBy("dataset_id", total).agg(*parts, *extra)
    quantiles = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col(total) - 1)
        part = position - F.floor(position)
        quantiles.append(
            (F.col(low[name]) + part * (F.col(high[name]) - F.col(low[name]))).alias(name)
        )
    helper = {total, *low.values(), *high.values()}
    return out.select(*[c for c in out.columns if c not in helper], *quantiles)


def gini(total: str = "n_cells", low: str = "sample_min") -> Column:
    """Aggregate over value counts with running totals ``upto``.

    With ties grouped, sum((2i - n - 1) x) is sum(c (2 upto - c - n) x).
    """
    x = F.col("value") - F.least(F.col(low), F.lit(0.0)) + 0.0000001
    c, n = F.col("c").cast("double"), F.col(total).cast("double")
    top = F.sum(x * c * (2 * F.col("upto").cast("double") - c - n))
    return F.try_divide(top, F.max(n) * F.sum(x * c))


def pooled(
    sample_df: DataFrame,
    quantile_scale: float = 0.01,
    base: DataFrame | None = None,
    counts: DataFrame | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """The 29 pooled meta-features, one row per dataset.

    Every order statistic comes from value counts, so the sorted data is the distinct values only.
    The counts are written once and read by the three steps below. ``counts`` may be given per
    feature: equal values are ranked in any order without changing the result.
    """
    base = sized(pooled_base(sample_df) if base is None else base)
    if counts is None:
        counts = durable(pooled_counts(sample_df))
    counts = counts.select("dataset_id", "value", "c")
    biggest = base.agg(F.max("n_cells")).first()[0] or 0
    keyed = counts.join(base.select("dataset_id", "n_cells", "sample_min"), "dataset_id")
    ranked = running_sums(
        keyed, ["dataset_id"], "value", {"upto": "c"}, max_group=biggest, window_rows=window_rows
    )
    probabilities = {"sample_median": 0.5}
    probabilities.update({k: p * quantile_scale for k, p in PERCENTILES.items()})
    order = exact_quantiles(
        ranked, "n_cells", probabilities, [gini().alias("sample_gini")]
    ).withColumn("iqr", F.col("q75") - F.col("q25"))
    centre = sized(base.join(order, "dataset_id"))
    bounds = centre.select(
        "dataset_id",
        "n_cells",
        "sample_median",
        "sample_mean",
        *[
            x
            for tag, lo, hi in (
                ("15iqr", F.col("q25") - 1.5 * F.col("iqr"), F.col("q75") + 1.5 * F.col("iqr")),
                ("3iqr", F.col("q25") - 3 * F.col("iqr"), F.col("q75") + 3 * F.col("iqr")),
                ("1_99", F.col("q1"), F.col("q99")),
                (
                    "3std",
                    F.col("sample_mean") - 3 * F.col("sample_std"),
                    F.col("sample_mean") + 3 * F.col("sample_std"),
                ),
            )
            for x in (lo.alias(f"lo_{tag}"), hi.alias(f"hi_{tag}"))
        ],
    )
    spread = counts.join(bounds, "dataset_id")
    tags = ("15iqr", "3iqr", "1_99", "3std")
    outside = {t: (F.col("value") < F.col(f"lo_{t}")) | (F.col("value") > F.col(f"hi_{t}")) for t in tags}
    deviation = F.abs(F.col("value") - F.col("sample_mean"))
    flags = spread.groupBy("dataset_id").agg(
        F.sum(deviation * F.col("c")).alias("_abs_dev"),
        *[F.sum(F.when(outside[t], F.col("c")).otherwise(0)).alias(f"_out_{t}") for t in tags],
    )
    distances = (
        spread.withColumn("value", F.abs(F.col("value") - F.col("sample_median")))
        .groupBy("dataset_id", "n_cells", "value")
        .agg(F.sum("c").alias("c"))
    )
    ranked_distances = running_sums(
        distances, ["dataset_id"], "value", {"upto": "c"},
        max_group=biggest, window_rows=window_rows,
    )
    mad = exact_quantiles(ranked_distances, "n_cells", {"med_abs_dev": 0.5})

    wide = centre.join(flags, "dataset_id").join(mad, "dataset_id")
    out = {name: F.col(name) for name in POOLED_NAMES if name in wide.columns}
    out["normalized_mean"] = F.try_divide(F.col("sample_mean"), F.col("sample_max"))
    out["normalized_median"] = F.try_divide(F.col("sample_median"), F.col("sample_max"))
    out["sample_range"] = F.col("sample_max") - F.col("sample_min")
    out["avg_abs_dev"] = F.col("_abs_dev") / F.col("n_cells")
    out["quant_coeff_disp"] = F.try_divide(F.col("iqr"), F.col("q75") + F.col("q25"))
    out["coeff_var"] = F.try_divide(F.col("sample_var"), F.col("sample_mean"))
    for t in tags:
        out[f"percent_outliers_{t}"] = F.col(f"_out_{t}") / F.col("n_samples")
        out[f"has_outliers_{t}"] = (F.col(f"_out_{t}") > 0).cast("int")
    return wide.select("dataset_id", *[out[name].alias(name) for name in POOLED_NAMES])
