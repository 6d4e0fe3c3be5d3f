"""Scaling, filling and splitting of keyed (dataset, column, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import clean, is_flat, zero_fill
from strayfinder.session import running_sums, sized


def column_means(table: DataFrame, column: str = "idx", value: str = "value") -> DataFrame:
    """Mean of each column, ignoring missing values."""
    return table.groupBy(column).agg(F.avg(clean(F.col(value))).alias("mean"))


def mean_fill(
    table: DataFrame,
    column: str = "idx",
    value: str = "value",
    means: DataFrame | None = None,
) -> DataFrame:
    """Fill missing values with the column mean; a column without values stays NULL.

    Pass stored ``means`` at serving time. Means come from partial aggregation and a join, not from
    a window, so a column with very many rows is never gathered in one task.
    """
    if means is None:
        means = sized(column_means(table, column, value))
    filled = F.coalesce(clean(F.col(value)), F.col("mean"))
    return table.join(means, column).withColumn(value, filled).drop("mean")


def zero_filled(table: DataFrame, value: str = "value") -> DataFrame:
    return table.withColumn(value, zero_fill(F.col(value)))


def min_max_fit(table: DataFrame, column: str = "idx", value: str = "value") -> DataFrame:
    v = clean(F.col(value))
    return table.groupBy(column).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def min_max_apply(
    table: DataFrame, ranges: DataFrame, column: str = "idx", value: str = "value"
) -> DataFrame:
    """Scale to [0, 1] with stored ranges; a constant column becomes 0, missing stays missing."""
    v = clean(F.col(value))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(v.isNotNull(), F.coalesce(F.try_divide(v - F.col("lo"), span), F.lit(0.0)))
    return table.join(sized(ranges), column).withColumn(value, scaled).drop("lo", "hi")


def standard_fit(
    table: DataFrame, column: str = "idx", value: str = "value", keys: tuple[str, ...] = ()
) -> DataFrame:
    v = clean(F.col(value))
    return table.groupBy(*keys, column).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def standard_apply(
    table: DataFrame,
    moments: DataFrame,
    column: str = "idx",
    value: str = "value",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    unit = F.when(is_flat(F.col("std"), F.col("mean")), 1.0).otherwise(F.col("std"))
    scaled = (clean(F.col(value)) - F.col("mean")) / unit
    return table.join(sized(moments), [*keys, column]).withColumn(value, scaled).drop("mean", "std")


def split_datasets(
    ids: DataFrame, fraction: float = 0.85, seed: int = 0, key: str = "dataset_id"
) -> DataFrame:
    """(key, split): the first floor(fraction n) ids in hash order train, the rest validate.

    ``ids`` lists datasets, one row each.
    """
    order = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    hashed = ids.select(key).distinct().select(
        key, F.concat(order, key).alias("_h"), F.lit(0).alias("_all"), F.lit(1).alias("_one")
    )
    n = hashed.count()
    ranked = running_sums(hashed, ["_all"], "_h", {"_rank": "_one"}, max_group=n)
    train = F.col("_rank") <= int(fraction * n)
    return ranked.select(key, F.when(train, "train").otherwise("valid").alias("split"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``."""
    return left.subtract(right)
