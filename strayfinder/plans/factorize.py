"""Learning dataset and model factors from past detection quality."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfinder.operators.evaluate import mean_ndcg
from strayfinder.operators.iforest import uniform_hash
from strayfinder.operators.pairs import matrix
from strayfinder.plans.history import should_stop
from strayfinder.session import durable

EMBEDDING_SCHEMA = "component int, weights array<double>, center double, scale double"
FACTOR_SCHEMA = "model_id int, v array<double>"
HISTORY_SCHEMA = "iteration int, rate double, train_ndcg double, valid_ndcg double"
# Pair matrices of models worked on at a time, in doubles; they stay in a core's cache.
_PAIR_CELLS = 100_000
# Datasets of one partition that forests are fitted on.
FOREST_ROWS = 10_000


# ------------------------------------------------------------------------------ dataset factors


def fit_embedding(vectors: DataFrame, factors: int) -> DataFrame:
    """Principal components of meta-feature vectors, scaled to unit population variance.

    ``vectors(dataset_id, features)``; the result has one row per component and 200 weights each.
    """
    table = vectors.select("dataset_id", array_to_vector("features").alias("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(table)
    pca = PCA(k=factors, inputCol="c", outputCol="z").fit(centred.transform(table))
    weights = pca.pc.toArray()
    center = np.asarray(centred.mean.toArray()) @ weights
    scores = pca.transform(centred.transform(table)).select(
        F.posexplode(vector_to_array("z")).alias("component", "z")
    )
    spread = {
        r.component: r.std
        for r in scores.groupBy("component").agg(F.stddev_pop("z").alias("std")).collect()
    }
    rows = [
        (k, weights[:, k].tolist(), float(center[k]), float(spread[k] if spread[k] > 1e-12 else 1.0))
        for k in range(factors)
    ]
    return vectors.sparkSession.createDataFrame(rows, EMBEDDING_SCHEMA)


def embed(vectors: DataFrame, embedding: DataFrame, out: str = "u") -> DataFrame:
    """(dataset_id, u): factors of each dataset. The embedding is 200 x K numbers."""
    rows = embedding.orderBy("component").collect()
    weights = np.array([r.weights for r in rows]).T
    center = np.array([r.center for r in rows])
    scale = np.array([r.scale for r in rows])

    def run(batches):
        for batch in batches:
            u = (matrix(batch["features"]) @ weights - center) / scale
            yield pd.DataFrame({"dataset_id": batch["dataset_id"], out: list(u)})

    return vectors.select("dataset_id", "features").mapInPandas(
        run, f"dataset_id string, {out} array<double>"
    )


def initial_model_factors(spark: SparkSession, models: int, factors: int, seed: int) -> DataFrame:
    """Normal with mean 0 and standard deviation 1 / factors; a function of the seed alone."""
    v = np.random.default_rng(seed).normal(scale=1.0 / factors, size=(models, factors))
    return factor_table(spark, v, range(models))


def factor_table(spark: SparkSession, v: np.ndarray, ids: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, v)], FACTOR_SCHEMA)


def factor_matrix(model_factors: DataFrame) -> np.ndarray:
    """Model factors as a matrix; one row per catalogue model."""
    return np.array([r.v for r in model_factors.orderBy("model_id").collect()])


def score_models(dataset_factors: DataFrame, model_factors: DataFrame) -> DataFrame:
    """(dataset_id, model_id, score = u . v). Each task multiplies its batch by the model matrix."""
    rows = model_factors.orderBy("model_id").collect()
    ids = np.array([r.model_id for r in rows])
    v = np.array([r.v for r in rows])

    def run(batches):
        for batch in batches:
            s = matrix(batch["u"]) @ v.T
            yield pd.DataFrame(
                {
                    "dataset_id": np.repeat(batch["dataset_id"].to_numpy(), len(ids)),
                    "model_id": np.tile(ids, len(batch)),
                    "score": s.ravel(),
                }
            )

    return dataset_factors.select("dataset_id", "u").mapInPandas(
        run, "dataset_id string, model_id int, score double"
    )


def rating_vectors(performance: DataFrame, ids: Iterable[int] | None = None) -> DataFrame:
    """(dataset_id, ratings): quality of all models in the order of ``ids``, one array per dataset.

    ``ids`` defaults to all models of the table, in order. A missing or NULL rating is NULL, so all
    arrays have the same length.
    """
    if ids is None:
        ids = sorted(r.model_id for r in performance.select("model_id").distinct().collect())
    order = F.array(*[F.lit(int(i)) for i in ids])
    rated = F.collect_list(F.struct(F.col("model_id").cast("int").alias("model_id"), "ap"))
    packed = performance.groupBy("dataset_id").agg(
        F.sort_array(rated).alias("_s"), F.map_from_entries(rated).alias("_r")
    )
    # a map is searched from its start for every model; complete datasets need no search
    looked_up = F.transform(order, lambda m: F.col("_r")[m])
    return packed.select(
        "dataset_id",
        F.when(F.col("_s.model_id") == order, F.col("_s.ap")).otherwise(looked_up).alias("ratings"),
    )


def _gains(ratings: np.ndarray) -> np.ndarray:
    """What a model adds to the objective; one without a rating adds nothing."""
    return np.nan_to_num(10.0 ** ratings - 1.0, nan=0.0)


# ------------------------------------------------------------------------------ the objective


def _smooth_ranks(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi (datasets x models) and the pair slopes (datasets x models x models)."""
    s = u @ v.T
    sig = s[:, :, None] - s[:, None, :]
    np.clip(sig, -700, 700, out=sig)
    np.exp(sig, out=sig)
    sig += 1.0
    np.divide(1.0, sig, out=sig)
    # the i = j term is 0.5, so 1.5 + the sum over j != i equals 1 + the full sum
    phi = 1.0 + sig.sum(axis=2)
    slope = 1.0 - sig
    slope *= sig
    return phi, slope


def objective(dataset_factors: DataFrame, ratings: DataFrame, model_factors: DataFrame) -> DataFrame:
    """(dataset_id, model_id, phi, term): smooth rank and its discounted gain, per model.

    ``ratings`` follow the order of the model ids.
    """
    rows = model_factors.orderBy("model_id").collect()
    ids, v = np.array([r.model_id for r in rows]), np.array([r.v for r in rows])

    def run(batches):
        for batch in batches:
            r = matrix(batch["ratings"])
            for start in range(0, len(batch), _chunk(v)):
                part = slice(start, start + _chunk(v))
                phi, _ = _smooth_ranks(matrix(batch["u"][part]), v)
                term = _gains(r[part]) / np.log(phi)
                yield pd.DataFrame(
                    {
                        "dataset_id": np.repeat(batch["dataset_id"][part].to_numpy(), len(v)),
                        "model_id": np.tile(ids, len(phi)),
                        "phi": phi.ravel(),
                        "term": term.ravel(),
                    }
                )

    return dataset_factors.join(ratings, "dataset_id").mapInPandas(
        run, "dataset_id string, model_id int, phi double, term double"
    )


def _chunk(v: np.ndarray) -> int:
    return max(1, _PAIR_CELLS // (len(v) * len(v)))


def gradient_step(
    dataset_factors: DataFrame,
    ratings: DataFrame,
    v: np.ndarray,
    rate: float,
    ids: Iterable[int] | None = None,
) -> DataFrame:
    """One synchronous step: moved dataset factors and partial sums of the model gradients.

    Rows with a ``dataset_id`` carry the new u; rows with a ``model_id`` carry a partial sum of that
    model's own-term gradient over the datasets of one batch. ``ids`` names the rows of ``v``.
    """
    names = np.arange(len(v)) if ids is None else np.asarray(list(ids))

    def run(batches):
        for batch in batches:
            r = matrix(batch["ratings"])
            u = matrix(batch["u"])
            gains = _gains(r)
            moved, pull = np.empty_like(u), np.empty((len(u), len(v)))
            for start in range(0, len(batch), _chunk(v)):
                part = slice(start, start + _chunk(v))
                phi, slope = _smooth_ranks(u[part], v)
                weight = gains[part] / (phi * np.log(phi) ** 2)
                own = slope.sum(axis=2)
                toward = np.matmul(weight[:, None, :], slope)[:, 0]
                moved[part] = u[part] - rate * (toward @ v - (weight * own) @ v)
                pull[part] = weight * (own - 0.25)
            yield pd.DataFrame(
                {
                    "dataset_id": batch["dataset_id"].to_numpy(),
                    "model_id": pd.array([None] * len(moved), dtype="Int32"),
                    "vec": list(moved),
                }
            )
            yield pd.DataFrame(
                {
                    "dataset_id": [None] * len(v),
                    "model_id": pd.array(names, dtype="Int32"),
                    "vec": list(pull.T @ u),
                }
            )

    return dataset_factors.join(ratings, "dataset_id").select(
        "dataset_id", "u", "ratings"
    ).mapInPandas(run, "dataset_id string, model_id int, vec array<double>")


def summed_gradient(step: DataFrame) -> DataFrame:
    """(model_id, k, grad): model gradients summed over all batches."""
    return (
        step.where("model_id IS NOT NULL")
        .select("model_id", F.posexplode("vec").alias("k", "g"))
        .groupBy("model_id", "k")
        .agg(F.sum("g").alias("grad"))
    )


def cyclic_rates(iterations: int, min_rate: float, max_rate: float, n_steps: int) -> list[float]:
    """Rates from min to max in equal steps, then back, repeated.

    The maximum ends every upward run and starts the downward one, so it appears twice in a row.
    """
    step = (max_rate - min_rate) / (n_steps - 1)
    up = [min_rate + i * step for i in range(n_steps - 1)] + [max_rate]
    cycle = up + up[::-1]
    return [cycle[i % len(cycle)] for i in range(iterations)]


# ------------------------------------------------------------------------------ forests


def fit_forests(
    inputs: DataFrame,
    targets: DataFrame,
    factors: int,
    trees: int = 100,
    depth: int = 10,
    seed: int = 0,
    parallelism: int = 4,
    bins: int | None = None,
) -> list:
    """One regression forest per factor; ``inputs(dataset_id, x)``, ``targets(dataset_id, u)``.

    ``bins`` bounds the split candidates of a feature; by default there is one per training dataset,
    which makes splits exact at every size.
    """
    parts = 1 + targets.count() // FOREST_ROWS
    table = (
        inputs.join(targets, "dataset_id")
        .select(
            "dataset_id",
            array_to_vector("x").alias("x"),
            *[F.element_at("u", k + 1).alias(f"u{k}") for k in range(factors)],
        )
        # bootstraps draw by partition and place, which must not depend on how the tables were read
        .repartition(parts, "dataset_id")
        .sortWithinPartitions("dataset_id")
        .cache()
    )
    if bins is None:
        bins = max(table.count(), 2)

    def fit(k: int):
        return RandomForestRegressor(
            featuresCol="x", labelCol=f"u{k}", predictionCol=f"p{k}", numTrees=trees,
            maxDepth=depth, maxBins=bins, featureSubsetStrategy="all", seed=seed + k,
        ).fit(table)

    pool = ThreadPool(min(parallelism, factors))
    try:
        return pool.map(inheritable_thread_target(table.sparkSession)(fit), range(factors))
    finally:
        pool.close()
        table.unpersist()


def predict_forests(inputs: DataFrame, forests: list) -> DataFrame:
    """(dataset_id, u) predicted from ``inputs(dataset_id, x)``."""
    table = inputs.select("dataset_id", array_to_vector("x").alias("x"))
    for k, forest in enumerate(forests):
        table = forest.setPredictionCol(f"p{k}").transform(table)
    return table.select(
        "dataset_id", F.array(*[F.col(f"p{k}") for k in range(len(forests))]).alias("u")
    )


# ------------------------------------------------------------------------------ the fit loop


@dataclass
class TrainedModel:
    embedding: DataFrame
    forests: list
    model_factors: DataFrame
    dataset_factors: DataFrame
    history: list[dict] = field(default_factory=list)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """Scores of all models for meta-feature vectors as wide as those it was trained on."""
        width = self.embedding.agg(F.max(F.size("weights"))).first()[0]
        wrong = vectors.where(F.size("features") != width).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0].dataset_id}: {len(wrong[0].features)} meta-features, not {width}")
        inputs = embed(vectors, self.embedding, "x")
        return score_models(predict_forests(inputs, self.forests), self.model_factors)


class Progress:
    """Written state of a training run: factors after each iteration and one history row for each.

    An iteration counts once its history row is there, which is written last; one that was cut off
    is done again and overwritten. Without a folder the rows are only kept for the session.
    """

    def __init__(self, spark: SparkSession, folder: str | None, run: str) -> None:
        self.spark, self.run = spark, run
        self.folder = None if folder is None else f"{folder}/{run}"
        self.rows: list[dict] = []
        if self.folder is not None:
            # the folder itself is not there before the first write
            spark.createDataFrame([(run,)], "run string").write.mode("overwrite").parquet(f"{self.folder}/history/iteration=0")
            written = spark.read.schema(HISTORY_SCHEMA).parquet(f"{self.folder}/history").where("valid_ndcg IS NOT NULL")
            self.rows = [r.asDict() for r in written.orderBy("iteration").collect()]

    def kept(self, name: str, table: DataFrame) -> DataFrame:
        """``table`` as it was when the run began."""
        if self.folder is None:
            return table
        if not self.rows:
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self.folder}/{name}")

    def factors(self) -> tuple[DataFrame, DataFrame]:
        """Dataset and model factors after the last iteration of a resumed run."""
        last = f"{self.folder}/factors/{self.rows[-1]['iteration']}"
        return self.spark.read.parquet(f"{last}/datasets"), self.spark.read.parquet(f"{last}/models")

    def add(self, row: dict, datasets: DataFrame, models: DataFrame) -> None:
        if self.folder is not None:
            here = f"{self.folder}/factors/{row['iteration']}"
            datasets.write.mode("overwrite").parquet(f"{here}/datasets")
            models.write.mode("overwrite").parquet(f"{here}/models")
            one = self.spark.createDataFrame([row], HISTORY_SCHEMA).drop("iteration")
            one.write.mode("overwrite").parquet(f"{self.folder}/history/iteration={row['iteration']}")
        self.rows.append(row)

    def history(self, extra: list[dict] = ()) -> DataFrame:
        """(run, iteration, rate, train_ndcg, valid_ndcg)."""
        rows = self.spark.createDataFrame([*self.rows, *extra], HISTORY_SCHEMA)
        return rows.withColumn("run", F.lit(self.run))


def train(
    vectors: DataFrame,
    performance: DataFrame,
    valid_vectors: DataFrame,
    valid_performance: DataFrame,
    factors: int = 40,
    iterations: int = 10,
    trees: int = 100,
    depth: int = 10,
    min_rate: float = 0.1,
    max_rate: float = 1.05,
    n_steps: int = 10,
    batch_fraction: float = 0.25,
    seed: int = 0,
    model_scale: float = 1.0,
    bins: int | None = None,
    folder: str | None = None,
) -> TrainedModel:
    """Fit factors by mini-batch steps; every step and every evaluation is a Spark job.

    The model factors move by ``rate * model_scale`` times the gradient summed over a batch, whatever
    its size.

    Dataset factors live in a DataFrame that is checkpointed after each step; only the model
    factors (models x factors numbers) are on the driver. Training ends where ``stopping_history``
    says so.

    With a shared ``folder`` the state after each iteration is written there, and a run that was cut
    off goes on after its last whole iteration; more ``iterations`` prolong a finished one. A folder
    belongs to one set of training tables; other settings get their own part of it.
    """
    spark = vectors.sparkSession
    # every step below reads these small tables again; they have a row per dataset (and model)
    vectors, performance = durable(vectors), durable(performance)
    valid_performance = durable(valid_performance)
    settings = (factors, trees, depth, min_rate, max_rate, n_steps, batch_fraction, seed, model_scale, bins)
    progress = Progress(spark, folder, "run-" + "-".join(str(x) for x in settings))
    embedding = progress.kept("embedding", fit_embedding(vectors, factors))
    inputs = durable(embed(vectors, embedding, "x"))
    valid_inputs = durable(embed(valid_vectors, embedding, "x"))
    ids = sorted(r.model_id for r in performance.select("model_id").distinct().collect())
    place = {model: k for k, model in enumerate(ids)}
    ratings = durable(rating_vectors(performance, ids))
    if progress.rows:
        u, models = progress.factors()
    else:
        u, models = inputs.withColumnRenamed("x", "u"), initial_model_factors(spark, len(ids), factors, seed)
    v = factor_matrix(models)
    batches = max(1, round(1 / batch_fraction))
    rates = cyclic_rates(iterations, min_rate, max_rate, n_steps)
    rule = {"min_rate": min_rate, "max_rate": max_rate, "n_steps": n_steps}
    stopped = bool(progress.rows) and should_stop(progress.history(), **rule)
    for i in range(len(progress.rows), iterations):
        if stopped:
            break
        table = factor_table(spark, v, ids)
        forests = fit_forests(inputs, u, factors, trees, depth, seed, bins=bins)
        train_ndcg = _quality(score_models(u, table), performance)
        valid_ndcg = _quality(
            score_models(predict_forests(valid_inputs, forests), table), valid_performance
        )
        row = {"iteration": i + 1, "rate": rates[i], "train_ndcg": train_ndcg, "valid_ndcg": valid_ndcg}
        stopped = should_stop(progress.history([row]), **rule)
        for b in range(0 if stopped else batches):
            chosen = F.floor(uniform_hash(F.lit(seed), F.lit(i), "dataset_id") * batches) == b
            step = durable(gradient_step(u.where(chosen), ratings, v, rates[i], ids))
            moved = step.where("dataset_id IS NOT NULL").select("dataset_id", F.col("vec").alias("u"))
            for r in summed_gradient(step).collect():  # models x factors numbers
                v[place[r.model_id], r.k] += rates[i] * model_scale * r.grad
            u = durable(u.where(~chosen).unionByName(moved))
        progress.add(row, u, factor_table(spark, v, ids))
    # the factors moved after the last forest was fitted
    forests = fit_forests(inputs, u, factors, trees, depth, seed, bins=bins)
    return TrainedModel(embedding, forests, factor_table(spark, v, ids), u, progress.rows)


def _quality(scores: DataFrame, performance: DataFrame) -> float:
    truth = performance.select("dataset_id", "model_id", F.col("ap").alias("truth"))
    return float(mean_ndcg(scores.join(truth, ["dataset_id", "model_id"])).first()[0])
