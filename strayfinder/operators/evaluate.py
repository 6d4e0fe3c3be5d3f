"""Ranking quality of detectors and of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strayfinder.session import durable, running_sums

PAIR = ("dataset_id", "model_id")


def masked_mse(df: DataFrame, pred: str, actual: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared error where the truth is not zero."""
    error = F.col(pred) - F.col(actual)
    return df.where(F.col(actual) != 0).groupBy(*keys).agg(F.avg(error * error).alias("mse"))


def average_precision(
    scored: DataFrame,
    keys: tuple[str, ...] = PAIR,
    score: str = "score",
    label: str = "label",
    window_rows: int | None = None,
) -> DataFrame:
    """Area under the precision-recall steps; equal scores are one step.

    Rows are first counted per score, and the running totals go through ``running_sums``, so one
    large dataset is never sorted by a single task. Without positives the result is NULL.
    """
    # written once: the scores behind it are costly, and it is measured before it is ranked
    steps = durable(
        scored.groupBy(*keys, score).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_tp")
        )
    )
    running = running_sums(
        steps, keys, score, {"_cum_n": "_n", "_cum_tp": "_tp"}, descending=True,
        window_rows=window_rows,
    )
    precision = F.col("_cum_tp") / F.col("_cum_n")
    total = F.sum("_tp")
    return running.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_tp") * precision), total).alias("ap"),
        F.sum("_n").alias("n_rows"),
        total.alias("n_positive"),
    )


def ndcg(
    scored: DataFrame, key: str = "dataset_id", truth: str = "truth", score: str = "score"
) -> DataFrame:
    """NDCG per dataset: linear gain, log2 discount, tied predictions share their mean gain.

    A dataset's rows are its models, bounded by the catalogue.
    """
    by_score = Window.partitionBy(key).orderBy(F.col(score).desc())
    by_truth = Window.partitionBy(key).orderBy(F.col(truth).desc())

    def discount(window):
        return 1.0 / F.log2(F.row_number().over(window) + F.lit(1.0))

    ranked = scored.select(
        key, truth, score, discount(by_score).alias("_d"), discount(by_truth).alias("_ideal")
    )
    tied = ranked.groupBy(key, score).agg(
        (F.avg(truth) * F.sum("_d")).alias("_dcg"), F.sum(F.col(truth) * F.col("_ideal")).alias("_best")
    )
    return tied.groupBy(key).agg(
        F.coalesce(F.try_divide(F.sum("_dcg"), F.sum("_best")), F.lit(0.0)).alias("ndcg")
    )


def mean_ndcg(scored: DataFrame, **columns: str) -> DataFrame:
    return ndcg(scored, **columns).agg(F.avg("ndcg").alias("mean_ndcg"))


def ensemble_mean(scores: DataFrame) -> DataFrame:
    """Average score over trained models per (dataset, model)."""
    return scores.groupBy(*PAIR).agg(F.avg("score").alias("score"))
