"""The training history as a table: learning rates, gains, and where training stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cyclic_rate(iteration: Column, min_rate: float, max_rate: float, n_steps: int) -> Column:
    """Rate of a 1-based iteration: up in ``n_steps`` equal steps, back down, repeated."""
    place = F.pmod(iteration - 1, F.lit(2 * n_steps))
    step = F.when(place < n_steps, place).otherwise(2 * n_steps - 1 - place)
    return F.lit(float(min_rate)) + step * ((max_rate - min_rate) / (n_steps - 1))


def stopping_history(
    history: DataFrame,
    min_rate: float,
    max_rate: float,
    n_steps: int,
    threshold: float = 0.001,
    patience: int = 5,
    key: str = "run",
) -> DataFrame:
    """Add ``gain``, ``stalled``, ``rate`` and ``trained`` to (run, iteration, valid_ndcg).

    ``stalled`` starts at 1, grows with each relative gain of at most ``threshold`` and returns to 1
    on an improvement; training ends with the first iteration where it exceeds ``patience``. A run
    has at most as many rows as iterations.
    """
    order = Window.partitionBy(key).orderBy("iteration")
    before = F.lag("valid_ndcg").over(order)
    gains = history.withColumn("gain", F.try_divide(F.col("valid_ndcg") - before, before))
    flat = F.coalesce(F.col("gain") <= threshold, F.lit(False)).cast("int")
    marked = gains.withColumn("_flat", flat).withColumn("_streak", F.sum(1 - F.col("_flat")).over(order))
    within = Window.partitionBy(key, "_streak").orderBy("iteration")
    counted = marked.withColumn("stalled", (1 + F.sum("_flat").over(within)).cast("int"))
    stop = F.min(F.when(F.col("stalled") > patience, F.col("iteration"))).over(
        Window.partitionBy(key)
    )
    return counted.select(
        *history.columns,
        "gain",
        "stalled",
        cyclic_rate(F.col("iteration"), min_rate, max_rate, n_steps).alias("rate"),
        F.coalesce(F.col("iteration") <= stop, F.lit(True)).alias("trained"),
    )


def should_stop(history: DataFrame, min_rate: float, max_rate: float, n_steps: int, **rule) -> bool:
    """Whether ``stopping_history`` ends a run with one of the rows written so far."""
    ends = stopping_history(history, min_rate, max_rate, n_steps, **rule)
    return bool(ends.agg(F.max(F.col("stalled") > rule.get("patience", 5))).first()[0])
