"""The candidate models: 302 detector configurations in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MODEL_SCHEMA = "model_id int, name string, family string, params map<string,string>"

# Hyperparameter grids (fixed values). The order of families and of keys gives the model order;
# the first key varies slowest.
GRIDS: list[tuple[str, dict[str, list]]] = [
    ("LODA", {
        "n_bins": [5, 10, 15, 20, 25, 30],
        "n_random_cuts": [10, 20, 30, 40, 50, 75, 100, 150, 200],
    }),
    ("ABOD", {"n_neighbors": [3, 5, 10, 15, 20, 25, 50, 60, 75, 80, 90, 100]}),
    ("IForest", {
        "n_estimators": [10, 20, 30, 40, 50, 75, 100, 150, 200],
        "max_features": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    }),
    ("KNN", {
        "method": ["largest", "mean", "median"],
        "n_neighbors": [1, 5, 10, 15, 20, 25, 50, 60, 70, 80, 90, 100],
    }),
    ("LOF", {
        "metric": ["manhattan", "euclidean", "minkowski"],
        "n_neighbors": [1, 5, 10, 15, 20, 25, 50, 60, 70, 80, 90, 100],
    }),
    ("HBOS", {
        "n_bins": [5, 10, 20, 30, 40, 50, 75, 100],
        "alpha": [0.1, 0.2, 0.3, 0.4, 0.5],
    }),
    ("OCSVM", {
        "kernel": ["linear", "poly", "rbf", "sigmoid"],
        "nu": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    }),
    ("COF", {"n_neighbors": [3, 5, 10, 15, 20, 25, 50]}),
]


def _family(spark: SparkSession, order: int, family: str, grid: dict[str, list]) -> DataFrame:
    """All settings of one family: each key's values are exploded in turn."""
    df = spark.range(1).select(F.lit(order).alias("_family"), F.lit(family).alias("family"))
    for i, (key, values) in enumerate(grid.items()):
        texts = F.array(*[F.lit(str(v)) for v in values])
        df = df.select("*", F.posexplode(texts).alias(f"_p{i}", key))
    pairs = [x for key in grid for x in (F.lit(key), F.col(key))]
    label = F.concat_ws(", ", *[F.concat(F.lit(f"{key}="), F.col(key)) for key in sorted(grid)])
    return df.select(
        "_family",
        "family",
        F.array(*[F.col(f"_p{i}") for i in range(len(grid))]).alias("_position"),
        F.concat(F.lit(f"{family}("), label, F.lit(")")).alias("name"),
        F.create_map(*pairs).alias("params"),
    )


def model_catalog(spark: SparkSession) -> DataFrame:
    """``models(model_id, name, family, params)`` with ids 0..301 in catalogue order."""
    table = None
    for order, (family, grid) in enumerate(GRIDS):
        part = _family(spark, order, family, grid)
        table = part if table is None else table.unionByName(part)
    rank = F.row_number().over(_catalog_window())
    return table.select(
        (rank - 1).cast("int").alias("model_id"), "name", "family", "params"
    )


def _catalog_window():
    from pyspark.sql import Window

    # 302 rows by construction: one window partition is the whole bounded catalogue
    return Window.partitionBy(F.lit(0)).orderBy("_family", "_position")
