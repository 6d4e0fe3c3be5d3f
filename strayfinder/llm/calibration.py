"""Isotonic calibration of raw scores, from counts per bin, and the labelled rows models learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BINS = 1024
FOLDS = 5
#: weight of the raw score in the result, so that rows on one step keep their order
SLOPE = 1e-3


@dataclass
class Calibration:
    """Raw scores in [low, high] to probabilities: non-decreasing, linear between the steps."""

    low: float
    high: float
    knots: np.ndarray
    values: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        raw = np.clip(np.nan_to_num(raw), self.low, self.high)
        place = (raw - self.low) / (self.high - self.low)
        steps = np.interp(raw, self.knots, self.values)
        return np.clip((1 - SLOPE) * steps + SLOPE * place, 0.0, 1.0)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x``; centres and shares of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, g, m in zip(x, good, n):
        blocks.append([a * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    centres = np.array([b[0] / b[2] for b in blocks])
    return centres, np.array([b[1] / b[2] for b in blocks])


def calibrate(scored: DataFrame, raw: str, label: str, low: float, high: float) -> Calibration:
    """Fit on (raw, 0/1 label) rows; only the ``BINS`` + 1 counts come to the driver."""
    inside = F.least(F.greatest(F.col(raw), F.lit(low)), F.lit(high))
    bins = (
        scored.select(inside.alias("x"), F.col(label).cast("double").alias("y"))
        .groupBy(F.floor((F.col("x") - low) / (high - low) * BINS).alias("bin"))
        .agg(F.avg("x").alias("x"), F.sum("y").alias("good"), F.count("*").alias("n"))
        .orderBy("bin")
        .toPandas()
    )
    if bins.empty:
        return Calibration(low, high, np.array([low, high]), np.array([0.5, 0.5]))
    knots, values = isotonic(bins["x"].to_numpy(float), bins["good"].to_numpy(float), bins["n"].to_numpy(float))
    return Calibration(low, high, knots, values)


def thresholds(raw: np.ndarray, labels: np.ndarray, low: float, high: float) -> Calibration:
    """As ``calibrate``, from the values of a bounded set of rows."""
    if not len(raw):
        return Calibration(low, high, np.array([low, high]), np.array([0.5, 0.5]))
    x, place = np.unique(np.clip(raw, low, high), return_inverse=True)
    good, n = np.bincount(place, weights=labels), np.bincount(place).astype(float)
    return Calibration(low, high, *isotonic(x, good, n))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text; folds are remainders."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.pmod(fold(doc_id), F.lit(FOLDS)) == 0


def training(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, label, calibrates): at most about ``rows`` labelled ids that aren't held out, by hash.

    Ids labelled more than once take their highest label; null ids and labels teach nothing. A fourth
    of the rows only calibrates.
    """
    usable = (
        labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
        .groupBy(labels[id_col].alias("id"))
        .agg(F.max(labels[label_col].cast("int")).alias("label"))
        .where(~held_out(F.col("id")))
    )
    share = min(1.0, rows / max(usable.count(), 1))
    chosen = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000)
    calibrates = F.pmod(F.floor(fold(F.col("id")) / FOLDS), F.lit(4)) == 0
    return usable.where(chosen).withColumn("calibrates", calibrates)
