"""Histogram-based outlier score (Goldstein and Dengel 2012)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import bin_index, bins_of, summaries, widen
from strayfinder.operators.pairs import matrix
from strayfinder.session import sized, with_parameters
from strayfinder.sources.datasets import cells

HBOS_BINS = 10


def feature_ranges(sample_df: DataFrame) -> DataFrame:
    return (
        cells(sample_df)
        .groupBy("dataset_id", "f_idx")
        .agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )


def histogram(
    sample_df: DataFrame, ranges: DataFrame, n_bins: int, counts: DataFrame | None = None
) -> DataFrame:
    """(dataset_id, f_idx, bin, c, n, lo, width) of the non-empty bins; given value counts stand for the rows."""
    values = cells(sample_df).withColumn("c", F.lit(1)) if counts is None else counts
    lo, hi = widen(F.col("lo"), F.col("hi"))
    edges = ranges.select("dataset_id", "f_idx", "n", lo.alias("lo"), hi.alias("hi"))
    return (
        values.join(edges, ["dataset_id", "f_idx"])
        .withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), n_bins))
        .groupBy("dataset_id", "f_idx", "bin")
        .agg(
            F.sum("c").alias("c"),
            F.max("n").alias("n"),
            F.max("lo").alias("lo"),
            F.max((F.col("hi") - F.col("lo")) / float(n_bins)).alias("width"),
        )
    )


def density(hist: DataFrame) -> DataFrame:
    return hist.withColumn("density", F.col("c") / (F.col("n") * F.col("width")))


def hbos_fit(sample_df: DataFrame, n_bins: int = HBOS_BINS, ranges: DataFrame | None = None) -> DataFrame:
    """(dataset_id, f_idx, lo, width, density array): all bins of a feature, empty ones 0."""
    ranges = sized(feature_ranges(sample_df)) if ranges is None else ranges
    filled = F.map_from_entries(F.collect_list(F.struct("bin", "density")))
    return (
        density(histogram(sample_df, ranges, n_bins))
        .groupBy("dataset_id", "f_idx", "lo", "width")
        .agg(filled.alias("_m"))
        .withColumn(
            "density",
            F.expr(f"transform(sequence(0, {n_bins - 1}), b -> coalesce(_m[b], 0D))"),
        )
        .drop("_m")
    )


def hbos_scores(sample_df: DataFrame, model: DataFrame, alphas=(0.1,), tol: float = 0.5) -> DataFrame:
    """(dataset_id, row_id, alpha, score), higher = more anomalous.

    One table lookup per cell; all ``alphas`` share it. With a small model there is no shuffle, and
    a streaming DataFrame is accepted. A value outside the fitted range counts as the end bin
    within ``tol`` bin widths of it, and as the emptiest bin further out.
    """
    alphas = [float(a) for a in alphas]

    def scores(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("f_idx")
        table = matrix(side["density"])
        lo, width = side["lo"].to_numpy(), side["width"].to_numpy()
        x, n = matrix(part["features"]), table.shape[1]
        hi = lo + width * n
        far = (x < lo - tol * width) | (x > hi + tol * width)
        found = table[np.arange(len(table)), bins_of(x, lo, hi, n)]
        found = np.where(far, table.min(axis=1), found)
        total = [-np.log2(found + a).sum(axis=1) for a in alphas]
        return pd.DataFrame(
            {
                "dataset_id": part["dataset_id"].iloc[0],
                "row_id": np.tile(part["row_id"].to_numpy(), len(alphas)),
                "alpha": np.repeat(alphas, len(part)),
                "score": np.concatenate(total),
            }
        )

    return with_parameters(
        sample_df.select("dataset_id", "row_id", "features"),
        model,
        scores,
        "dataset_id string, row_id bigint, alpha double, score double",
    )


def hbos_landmarks(hist: DataFrame, n_bins: int = HBOS_BINS) -> DataFrame:
    """Summaries over features of the mean, largest and smallest bin density."""
    d = F.col("density")
    per_feature = (
        density(hist)
        .groupBy("dataset_id", "f_idx")
        .agg(
            (F.sum(d) / n_bins).alias("HBOS_mean"),
            F.max(d).alias("HBOS_max"),
            F.when(F.count(d) < n_bins, 0.0).otherwise(F.min(d)).alias("HBOS_min"),
        )
    )
    return summaries(per_feature, ("HBOS_mean", "HBOS_max", "HBOS_min"))
