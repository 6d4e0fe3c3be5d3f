"""Fitted tables and models on shared storage."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession


def save_tables(folder: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_forests(folder: str, forests: list[RandomForestRegressionModel]) -> None:
    for k, forest in enumerate(forests):
        forest.write().overwrite().save(f"{folder}/forest_{k}")


def load_forests(folder: str, count: int) -> list[RandomForestRegressionModel]:
    return [RandomForestRegressionModel.load(f"{folder}/forest_{k}") for k in range(count)]
