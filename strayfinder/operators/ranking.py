"""Top-n selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayfinder.functions.scalar import clean


def ranked_models(
    scores: DataFrame, key: str = "dataset_id", item: str = "model_id", score: str = "score"
) -> DataFrame:
    """Add ``rank`` 1..m by descending score; the larger id wins ties, missing scores are dropped."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item).desc())
    kept = scores.withColumn(score, clean(F.col(score))).where(F.col(score).isNotNull())
    return kept.withColumn("rank", F.row_number().over(w))


def top_models(scores: DataFrame, n: int, **columns: str) -> DataFrame:
    """The n best items per key; each task drops all others before the shuffle."""
    return ranked_models(scores, **columns).where(F.col("rank") <= n)


def nth_model(scores: DataFrame, nth: int, **columns: str) -> DataFrame:
    return ranked_models(scores, **columns).where(F.col("rank") == nth)


def best_item(score: str = "score", item: str = "model_id") -> Column:
    """Aggregate: the first item of the largest score, ignoring missing scores."""
    s = clean(F.col(score))
    return F.max_by(F.when(s.isNotNull(), F.col(item)), F.when(s.isNotNull(), F.struct(s, -F.col(item))))
