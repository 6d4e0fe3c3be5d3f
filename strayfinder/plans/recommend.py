"""Choosing models for new datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfinder.functions.scalar import dot
from strayfinder.operators import transform
from strayfinder.operators.evaluate import ensemble_mean
from strayfinder.operators.neighbors import knn_edges
from strayfinder.operators.ranking import top_models
from strayfinder.plans.factorize import TrainedModel, train
from strayfinder.plans.profile import META_WIDTH, meta_vectors, profile
from strayfinder.session import durable
from strayfinder.sources.artifacts import load_forests, load_tables, save_forests, save_tables
from strayfinder.sources.datasets import validate


@dataclass
class Recommender:
    """Everything serving needs: scaling, catalogue, and one trained model per seed."""

    ranges: DataFrame
    means: DataFrame
    models: DataFrame
    trained: list[TrainedModel]

    def scores(self, meta: DataFrame, impute: str = "zero") -> DataFrame:
        """(dataset_id, model_id, score) averaged over the trained models."""
        vectors = durable(meta_vectors(scaled_meta(meta, self.ranges, self.means, impute)))
        validate(vectors, META_WIDTH)
        parts = None
        for model in self.trained:
            part = model.predict(vectors)
            parts = part if parts is None else parts.unionByName(part)
        return ensemble_mean(parts)

    def recommend(self, sample_df: DataFrame, n: int = 1, impute: str = "zero") -> DataFrame:
        """ranking(dataset_id, rank, model_id, name, score): the n best models per dataset."""
        return self.recommend_profiled(profile(sample_df), n, impute)

    def recommend_profiled(self, meta: DataFrame, n: int = 1, impute: str = "zero") -> DataFrame:
        return named_ranking(top_models(self.scores(meta, impute), n), self.models)


def named_ranking(ranking: DataFrame, models: DataFrame) -> DataFrame:
    """Look model names up; the catalogue has 302 rows."""
    return ranking.join(F.broadcast(models.select("model_id", "name")), "model_id").select(
        "dataset_id", "rank", "model_id", "name", "score"
    )


def scaled_meta(
    meta: DataFrame, ranges: DataFrame, means: DataFrame | None = None, impute: str = "zero"
) -> DataFrame:
    """Serving order: ``zero`` fills before scaling, ``mean`` scales and then uses stored means."""
    if impute == "zero":
        return transform.min_max_apply(transform.zero_filled(meta), ranges)
    scaled = transform.min_max_apply(meta, ranges)
    return transform.zero_filled(transform.mean_fill(scaled, means=means))


def fit_recommender(
    meta: DataFrame,
    performance: DataFrame,
    models: DataFrame,
    seeds: Sequence[int] = (0, 2),
    fraction: float = 0.85,
    **settings,
) -> Recommender:
    """Learn from profiled datasets and their performance, joined by dataset id.

    ``performance(dataset_id, model_id, ap)`` may miss entries; they take the model's mean.
    """
    performance = durable(performance)
    known = durable(performance.select("dataset_id").intersect(meta.select("dataset_id")))
    meta = meta.join(known, "dataset_id", "left_semi")
    performance = durable(
        complete_performance(performance.join(known, "dataset_id", "left_semi"), known)
    )
    ranges = transform.min_max_fit(meta).persist()
    scaled = transform.min_max_apply(meta, ranges)
    means = transform.column_means(scaled).persist()
    filled = transform.zero_filled(transform.mean_fill(scaled, means=means))
    vectors = durable(meta_vectors(filled))
    trained = []
    for seed in seeds:
        split = transform.split_datasets(known, fraction, seed).persist()
        side = {
            s: split.where(F.col("split") == s).select("dataset_id") for s in ("train", "valid")
        }
        trained.append(
            train(
                vectors.join(side["train"], "dataset_id"),
                performance.join(side["train"], "dataset_id"),
                vectors.join(side["valid"], "dataset_id"),
                performance.join(side["valid"], "dataset_id"),
                seed=seed,
                **settings,
            )
        )
    return Recommender(ranges, means, models, trained)


def complete_performance(performance: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every (dataset, model) entry, missing ones filled with the model's mean quality.

    The model list is one bounded array, exploded per dataset.
    """
    ids = performance.agg(F.array_sort(F.collect_set("model_id"))).first()[0]
    frame = datasets.select(
        "dataset_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("model_id")
    )
    table = frame.join(performance, ["dataset_id", "model_id"], "left")
    return transform.mean_fill(table, "model_id", "ap").select("dataset_id", "model_id", "ap")


def save_recommender(folder: str, r: Recommender) -> None:
    save_tables(folder, ranges=r.ranges, means=r.means, models=r.models)
    for i, t in enumerate(r.trained):
        save_tables(
            f"{folder}/trained_{i}",
            embedding=t.embedding,
            model_factors=t.model_factors,
            dataset_factors=t.dataset_factors,
        )
        save_forests(f"{folder}/trained_{i}", t.forests)


def load_recommender(spark: SparkSession, folder: str, count: int) -> Recommender:
    shared = load_tables(spark, folder, "ranges", "means", "models")
    trained = []
    for i in range(count):
        t = load_tables(
            spark, f"{folder}/trained_{i}", "embedding", "model_factors", "dataset_factors"
        )
        forests = load_forests(f"{folder}/trained_{i}", t["embedding"].count())
        trained.append(
            TrainedModel(t["embedding"], forests, t["model_factors"], t["dataset_factors"])
        )
    return Recommender(shared["ranges"], shared["means"], shared["models"], trained)


def similar_datasets(vectors: DataFrame, k: int = 1) -> DataFrame:
    """(dataset_id, similar_id, rank, distance, cosine): the k datasets of nearest meta-features.

    Runs the exact neighbour join with datasets as rows, so the pairs of all datasets are never
    written out.
    """
    named = vectors.select(
        F.lit("meta").alias("dataset_id"),
        F.xxhash64("dataset_id").alias("row_id"),
        "features",
        F.col("dataset_id").alias("_name"),
    )
    edges = knn_edges(named, k)
    left = named.select("row_id", F.col("features").alias("_a"), F.col("_name").alias("_from"))
    right = named.select(
        F.col("row_id").alias("nbr_id"), F.col("features").alias("_b"), F.col("_name").alias("_to")
    )
    length = F.sqrt(dot(F.col("_a"), F.col("_a"))) * F.sqrt(dot(F.col("_b"), F.col("_b")))
    return (
        edges.join(left, "row_id")
        .join(right, "nbr_id")
        .select(
            F.col("_from").alias("dataset_id"),
            F.col("_to").alias("similar_id"),
            "rank",
            F.col("dist").alias("distance"),
            F.try_divide(dot(F.col("_a"), F.col("_b")), length).alias("cosine"),
        )
    )
