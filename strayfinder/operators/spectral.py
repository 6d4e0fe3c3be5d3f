"""Principal components from per-dataset covariance matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strayfinder.functions.scalar import summaries
from strayfinder.operators.pairs import feature_arrays, matrix
from strayfinder.session import Fold, fold_with_parameters, with_parameters

COMPONENTS = 3
SPECTRAL_NAMES = (
    "pca_expl_ratio_1", "pca_expl_ratio_2", "pca_expl_ratio_3",
    "pca_sv_1", "pca_sv_2", "pca_sv_3",
)
FIRST_ROW_NAMES = ("first_pca_std", "first_pca_skewness", "first_pca_kurtosis")

_EIGEN_SCHEMA = (
    "dataset_id string, component int, eigenvalue double, share double, n bigint, "
    "vector array<double>, mean array<double>, std array<double>"
)


def eigen(
    products: DataFrame, base: DataFrame, components: int | None = COMPONENTS, scaled: bool = False
) -> DataFrame:
    """Leading eigenpairs of the population covariance (or correlation) matrix of each dataset.

    A group is one p x p matrix, bounded by the row width, never by the number of rows. Constant
    columns of a scaled matrix are zero rows. ``share`` is the eigenvalue over the trace.
    """
    stats = feature_arrays(base, "mean", "std")

    def solve(entries: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if entries.empty or side.empty:
            return pd.DataFrame()
        n = int(side["n"].iloc[0])
        mean = np.asarray(side["mean"].iloc[0], dtype=float)
        std = np.asarray(side["std"].iloc[0], dtype=float)
        p = len(mean)
        m = np.zeros((p, p))
        m[entries["i"], entries["j"]] = entries["s"] / n
        m[entries["j"], entries["i"]] = entries["s"] / n
        if scaled:
            flat = std <= 1e-12 * np.maximum(1.0, np.abs(mean))
            unit = np.where(flat, 1.0, std)
            m = m / np.outer(unit, unit)
            m[flat, :] = 0.0
            m[:, flat] = 0.0
        values, vectors = np.linalg.eigh(m)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        # a fixed sign: the largest weight of each vector is positive
        lead = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[lead, np.arange(p)] < 0, -1.0, 1.0)
        k = p if components is None else min(components, p)
        total = values.sum()
        return pd.DataFrame(
            {
                "dataset_id": side["dataset_id"].iloc[0],
                "component": np.arange(k),
                "eigenvalue": values[:k],
                "share": values[:k] / total if total > 0 else np.full(k, np.nan),
                "n": n,
                "vector": [vectors[:, i].tolist() for i in range(k)],
                "mean": [mean.tolist()] * k,
                "std": [std.tolist()] * k,
            }
        )

    products, stats = products.toDF(*products.columns), stats.toDF(*stats.columns)
    return (
        products.groupBy("dataset_id")
        .cogroup(stats.groupBy("dataset_id"))
        .applyInPandas(solve, _EIGEN_SCHEMA)
    )


def project(sample_df: DataFrame, eigenpairs: DataFrame, scaled: bool = False) -> DataFrame:
    """(dataset_id, row_id, component, score): centred rows on each component."""

    def scores(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        z, vectors = _components(rows, side, scaled)
        t = z @ vectors
        k = t.shape[1]
        return pd.DataFrame(
            {
                "dataset_id": rows["dataset_id"].iloc[0],
                "row_id": np.repeat(rows["row_id"].to_numpy(), k),
                "component": np.tile(np.sort(side["component"].to_numpy()), len(rows)),
                "score": t.ravel(),
            }
        )

    return with_parameters(
        sample_df.select("dataset_id", "row_id", "features"),
        eigenpairs,
        scores,
        "dataset_id string, row_id bigint, component int, score double",
    )


def _components(rows: pd.DataFrame, side: pd.DataFrame, scaled: bool):
    side = side.sort_values("component")
    mean = np.asarray(side["mean"].iloc[0], dtype=float)
    z = matrix(rows["features"]) - mean
    if scaled:
        std = np.asarray(side["std"].iloc[0], dtype=float)
        flat = std <= 1e-12 * np.maximum(1.0, np.abs(mean))
        z = np.where(flat, 0.0, z / np.where(flat, 1.0, std))
    return z, matrix(side["vector"]).T


def first_row_scores(sample_df: DataFrame, eigenpairs: DataFrame) -> DataFrame:
    """Long summary: spread of the first row's three component scores; the first row has the least ``row_id``.

    Signs are fixed so that the score of largest magnitude in each component is positive, which
    takes the extremes of every component: each task sends one row per dataset and component.
    """
    fold = first_row_fold(eigenpairs)
    return first_row_summary(
        fold_with_parameters(
            sample_df.select("dataset_id", "row_id", "features"),
            fold.params, fold.step, fold.finish, fold.schema, prepare=fold.prepare,
        )
    )


def first_row_fold(eigenpairs: DataFrame) -> Fold:
    """The scan of ``first_row_scores``: extremes of each component and the scores of a task's first row."""

    def prepare(side: pd.DataFrame):
        side = side.sort_values("component")
        mean = np.asarray(side["mean"].iloc[0], dtype=float)
        return mean, matrix(side["vector"]).T, side["component"].to_numpy()

    def widen(state, rows, side):
        mean, vectors, _ = side
        t = (matrix(rows["features"]) - mean) @ vectors
        ids = np.asarray(rows["row_id"])
        first = int(np.argmin(ids))
        own = t.min(axis=0), t.max(axis=0), ids[first : first + 1], t[first]
        if state is None:
            return own
        earlier = state if state[2][0] <= own[2][0] else own
        return np.minimum(state[0], own[0]), np.maximum(state[1], own[1]), earlier[2], earlier[3]

    def extremes(dataset, state, side) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "dataset_id": dataset,
                "component": side[2],
                "low": state[0],
                "high": state[1],
                "row_id": state[2][0],
                "score": state[3],
            }
        )

    return Fold(
        eigenpairs,
        widen,
        extremes,
        "dataset_id string, component int, low double, high double, row_id bigint, score double",
        prepare,
    )


def first_row_summary(parts: DataFrame) -> DataFrame:
    """``first_row_scores`` from what the tasks found."""
    score = F.min_by("score", "row_id")
    signed = parts.groupBy("dataset_id", "component").agg(
        F.when(-F.min("low") > F.max("high"), -score).otherwise(score).alias("score")
    )
    # fewer than three components leave the block undefined
    full = Window.partitionBy("dataset_id")
    enough = F.count(F.lit(1)).over(full) >= COMPONENTS
    named = signed.withColumn("first_pca", F.when(enough, F.col("score")))
    return summaries(named, ["first_pca"], ("std", "skewness", "kurtosis"))


def pca_landmarks(eigenpairs: DataFrame) -> DataFrame:
    """Explained share and singular value of the three leading standardised components."""
    sv = F.sqrt(F.col("n").cast("double") * F.col("eigenvalue"))
    parts = []
    for k in range(COMPONENTS):
        parts.append(F.max(F.when(F.col("component") == k, _number("share"))).alias(f"pca_expl_ratio_{k + 1}"))
    for k in range(COMPONENTS):
        parts.append(F.max(F.when(F.col("component") == k, sv)).alias(f"pca_sv_{k + 1}"))
    # fewer than three features leave the whole block NULL
    out = eigenpairs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_k"), *parts)
    return out.select(
        "dataset_id",
        *[F.when(F.col("_k") >= COMPONENTS, F.col(c)).alias(c) for c in SPECTRAL_NAMES],
    )


def _number(column: str):
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


def pca_scores(sample_df: DataFrame, eigenpairs: DataFrame) -> DataFrame:
    """Outlier score of a row: distance to every component vector, weighted by 1 / share.

    Follows the principal-component classifier of Shyu et al. (2003) as the detector libraries
    define it; ``eigenpairs`` must come from the scaled matrix.
    """

    def scores(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        z, vectors = _components(rows, side, True)
        share = side.sort_values("component")["share"].to_numpy(float)
        used = share > 0
        total = np.zeros(len(rows))
        for v, w in zip(vectors.T[used], share[used]):
            total += np.sqrt(((z - v) ** 2).sum(axis=1)) / w
        return pd.DataFrame(
            {
                "dataset_id": rows["dataset_id"].iloc[0],
                "row_id": rows["row_id"].to_numpy(),
                "score": total,
            }
        )

    return with_parameters(
        sample_df.select("dataset_id", "row_id", "features"),
        eigenpairs,
        scores,
        "dataset_id string, row_id bigint, score double",
    )
