"""Correlation, covariance and variance-ratio tests of every feature pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import summaries
from strayfinder.functions.special import anova_f, anova_p
from strayfinder.session import Fold, fold_with_parameters

PAIR_BLOCKS = ("correlation", "covariance", "anova_p_value")


def matrix(column: pd.Series | np.ndarray) -> np.ndarray:
    """Rows of an array column as one 2-D array."""
    if isinstance(column, np.ndarray) and column.ndim == 2:
        return column
    return np.vstack(column.to_numpy()).astype(float, copy=False)


def feature_arrays(base: DataFrame, *columns: str) -> DataFrame:
    """Per dataset, arrays over features in feature order of the given statistics."""
    packed = F.array_sort(F.collect_list(F.struct("f_idx", *columns)))
    return (
        base.groupBy("dataset_id")
        .agg(packed.alias("_s"), F.max("n").alias("n"))
        .select("dataset_id", "n", *[F.col(f"_s.{c}").alias(c) for c in columns])
    )


def cross_products(sample_df: DataFrame, base: DataFrame) -> DataFrame:
    """(dataset_id, i, j, s): centred sums of products for i >= j.

    Matrix products are summed within a task; p(p+1)/2 sums per task and dataset are shuffled, never
    the rows. Centring on the known means keeps the sums accurate for data far from zero.
    """
    fold = product_fold(base)
    return summed_products(
        fold_with_parameters(
            sample_df.select("dataset_id", "features"),
            fold.params, fold.step, fold.finish, fold.schema, prepare=fold.prepare,
        )
    )


def summed_products(parts: DataFrame) -> DataFrame:
    """``cross_products`` from the sums of every task."""
    return parts.groupBy("dataset_id", "i", "j").agg(F.sum("s").alias("s"))


def product_fold(base: DataFrame) -> Fold:
    """The scan of ``cross_products``: sums of products per task."""

    def add(state, rows, mean: np.ndarray):
        x = matrix(rows["features"]) - mean
        product = x.T @ x
        return (product if state is None else state[0] + product,)

    def sums(dataset, state, _) -> pd.DataFrame:
        i, j = np.tril_indices(len(state[0]))
        return pd.DataFrame({"dataset_id": dataset, "i": i, "j": j, "s": state[0][i, j]})

    return Fold(
        feature_arrays(base, "mean"),
        add,
        sums,
        "dataset_id string, i int, j int, s double",
        lambda side: np.asarray(side["mean"].iloc[0], dtype=float),
    )


def pair_stats(products: DataFrame, base: DataFrame) -> DataFrame:
    """(dataset_id, i, j, correlation, covariance, anova_f, anova_p_value) for i > j.

    The self-join is on per-feature statistics (p rows per dataset), not on data rows. A constant
    feature has correlation 0.
    """
    stat = base.select("dataset_id", "f_idx", "n", "mean", "var", "std")
    a = stat.select("dataset_id", F.col("f_idx").alias("i"), "n", *_renamed("a"))
    b = stat.select("dataset_id", F.col("f_idx").alias("j"), *_renamed("b"))
    n = F.col("n").cast("double")
    f = anova_f(F.col("n"), F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b"))
    flat = (F.col("var_a") == 0) | (F.col("var_b") == 0)
    r = F.try_divide(F.col("s") / n, F.col("std_a") * F.col("std_b"))
    return (
        products.where("i > j")
        .join(a, ["dataset_id", "i"])
        .join(b, ["dataset_id", "j"])
        .select(
            "dataset_id",
            "i",
            "j",
            "n",
            F.when(flat, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("correlation"),
            F.try_divide(F.col("s"), n - 1).alias("covariance"),
            f.alias("anova_f"),
        )
        .withColumn("anova_p_value", anova_p(F.col("anova_f"), F.col("n")))
    )


def _renamed(tag: str) -> list:
    return [F.col(c).alias(f"{c}_{tag}") for c in ("mean", "var", "std")]


def pair_summaries(stats: DataFrame, blocks: tuple[str, ...] = PAIR_BLOCKS) -> DataFrame:
    return summaries(stats, blocks)


def flatten_diagonally(entries: DataFrame, size: str = "n", diagonals=None) -> DataFrame:
    """Add ``diag`` and ``position`` to square-matrix cells (i, j, v), diagonal by diagonal.

    Diagonals start at the bottom-left corner, so the strict lower triangle comes first. The
    position is arithmetic, not a window: cells on earlier diagonals plus the offset in this one.
    """
    n, i, j = F.col(size), F.col("i"), F.col("j")
    diag = (n - 1) - (i - j)
    lower = diag * (diag + 1) / 2
    below = 2 * n - 1 - diag
    upper = n * n - below * (below + 1) / 2
    start = F.when(diag < n, lower).otherwise(upper)
    out = entries.withColumn("diag", diag.cast("int")).withColumn(
        "position", (start + F.least(i, j)).cast("bigint")
    )
    return out if diagonals is None else out.where(F.col("diag").isin(*diagonals))


__all__ = [
    "cross_products", "feature_arrays", "flatten_diagonally", "matrix",
    "pair_stats", "pair_summaries",
]
