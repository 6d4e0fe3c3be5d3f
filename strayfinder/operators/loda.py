"""Sparse random projections with one histogram each (Pevny 2016)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import bins_of, summaries
from strayfinder.operators.pairs import matrix
from strayfinder.session import Fold, arrow_batches, fold_with_parameters, per_dataset, with_parameters

LODA_BINS, LODA_CUTS = 10, 100
# Projections worked on at a time; they stay in a core's cache.
_BLOCK_CELLS = 25_000


def cut_weights(width: int, cuts: int, seed: int = 0) -> np.ndarray:
    """(width, cuts) weights: floor(sqrt(width)) standard normals per cut, zeros elsewhere.

    Every weight is a function of (seed, cut, feature) alone, so neither partitioning nor task
    order can change it, and fewer cuts are a prefix of more.
    """
    kept = max(1, int(np.floor(np.sqrt(width))))
    w = np.zeros((width, cuts))
    for cut in range(cuts):
        digests = [hashlib.md5(f"{seed}:{cut}:{f}".encode()).hexdigest() for f in range(width)]
        for f in sorted(range(width), key=lambda f: digests[f][16:])[:kept]:
            u1 = (int(digests[f][:8], 16) + 0.5) / 4294967296.0
            u2 = (int(digests[f][8:16], 16) + 0.5) / 4294967296.0
            w[f, cut] = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
    return w


class _Weights:
    """Weights per width, computed once per Python worker."""

    def __init__(self, cuts: int, seed: int):
        self.cuts, self.seed, self.cache = cuts, seed, {}

    def __call__(self, width: int) -> np.ndarray:
        if width not in self.cache:
            self.cache[width] = cut_weights(width, self.cuts, self.seed)
        return self.cache[width]


def loda_fit(
    sample_df: DataFrame, n_bins: int = LODA_BINS, cuts: int = LODA_CUTS, seed: int = 0
) -> DataFrame:
    """(dataset_id, cut, lo, hi, prob array) in two scans; only partial histograms are shuffled."""
    rows = sample_df.select("dataset_id", "features")
    fold = range_fold(cuts, seed)

    def extremes(batches):
        yield from arrow_batches(per_dataset(batches, fold.step, fold.finish), fold.schema)

    ranges = cut_ranges(rows.mapInArrow(extremes, fold.schema))
    fold = count_fold(ranges, n_bins, cuts, seed)
    counted = fold_with_parameters(
        rows, fold.params, fold.step, fold.finish, fold.schema, prepare=fold.prepare
    )
    return cut_histograms(counted, n_bins)


def _projected(part, weights: _Weights) -> Iterator[np.ndarray]:
    x = matrix(part["features"])
    w, step = weights(x.shape[1]), max(_BLOCK_CELLS // weights.cuts, 1)
    for start in range(0, len(x), step):
        yield x[start : start + step] @ w


def range_fold(cuts: int = LODA_CUTS, seed: int = 0) -> Fold:
    """The first scan of ``loda_fit``: least and largest projection per cut."""
    weights = _Weights(cuts, seed)

    def widen(state, part, _):
        low, high = (np.full(cuts, np.inf), np.full(cuts, -np.inf)) if state is None else state
        for z in _projected(part, weights):
            low, high = np.minimum(low, z.min(axis=0)), np.maximum(high, z.max(axis=0))
        return low, high

    def ends(dataset, state, _) -> pd.DataFrame:
        return pd.DataFrame({"dataset_id": dataset, "cut": np.arange(cuts), "lo": state[0], "hi": state[1]})

    return Fold(None, widen, ends, "dataset_id string, cut int, lo double, hi double")


def cut_ranges(parts: DataFrame) -> DataFrame:
    """(dataset_id, cut, lo, hi) from what the tasks found."""
    flat = F.col("lo") == F.col("hi")
    return (
        parts.groupBy("dataset_id", "cut")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(
            "dataset_id",
            "cut",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )


def count_fold(
    ranges: DataFrame, n_bins: int = LODA_BINS, cuts: int = LODA_CUTS, seed: int = 0
) -> Fold:
    """The second scan of ``loda_fit``: rows per cut and bin."""
    weights = _Weights(cuts, seed)

    def prepare(side: pd.DataFrame):
        side = side.sort_values("cut")
        return side["lo"].to_numpy(), side["hi"].to_numpy()

    def count(state, part, side):
        counts = np.zeros(cuts * n_bins, dtype=int) if state is None else state[0]
        first = np.arange(cuts) * n_bins
        for z in _projected(part, weights):
            counts = counts + np.bincount((bins_of(z, *side, n_bins) + first).ravel(), minlength=cuts * n_bins)
        return (counts,)

    def filled(dataset, state, side) -> pd.DataFrame:
        # empty bins are added behind the sum; a task sends those it has seen
        lo, hi = side
        seen = np.flatnonzero(state[0])
        return pd.DataFrame(
            {
                "dataset_id": dataset,
                "cut": seen // n_bins,
                "bin": seen % n_bins,
                "lo": lo[seen // n_bins],
                "hi": hi[seen // n_bins],
                "c": state[0][seen],
            }
        )

    return Fold(
        ranges,
        count,
        filled,
        "dataset_id string, cut int, bin int, lo double, hi double, c bigint",
        prepare,
    )


def cut_histograms(counted: DataFrame, n_bins: int = LODA_BINS) -> DataFrame:
    """The model of ``loda_fit`` from the counts of every task."""
    per_bin = counted.groupBy("dataset_id", "cut", "bin", "lo", "hi").agg(F.sum("c").alias("c"))
    found = F.map_from_entries(F.collect_list(F.struct("bin", "c")))
    every = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(F.col("_b")[b], F.lit(0)) + 1e-12
    )
    return (
        per_bin.groupBy("dataset_id", "cut", "lo", "hi")
        .agg(found.alias("_b"), (F.sum("c") + n_bins * 1e-12).alias("_t"))
        .select(
            "dataset_id",
            "cut",
            "lo",
            "hi",
            F.transform(every, lambda c: c / F.col("_t")).alias("prob"),
        )
    )


def loda_scores(
    sample_df: DataFrame, model: DataFrame, seed: int = 0, counts: Sequence[int] | None = None
) -> DataFrame:
    """(dataset_id, row_id, score): minus the mean log density over the cuts.

    ``model`` may hold the first cuts of a larger fit. Values outside the range use the end bin. With
    ``counts``, one scan gives a score for the first c cuts of each c, as rows with a column ``cuts``.
    """
    cache: dict[int, _Weights] = {}

    def scores(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = side.sort_values("cut")
        cuts = len(side)
        weights = cache.setdefault(cuts, _Weights(cuts, seed))
        x = matrix(part["features"])
        prob = matrix(side["prob"])
        z = x @ weights(x.shape[1])
        index = bins_of(z, side["lo"].to_numpy(), side["hi"].to_numpy(), prob.shape[1])
        found = np.log(prob)[np.arange(cuts), index]
        wanted = [cuts] if counts is None else list(counts)
        return pd.concat(
            [
                pd.DataFrame(
                    {
                        "dataset_id": part["dataset_id"].iloc[0],
                        "row_id": part["row_id"].to_numpy(),
                        "cuts": c,
                        "score": -found[:, :c].mean(axis=1),
                    }
                )
                for c in wanted
            ],
            ignore_index=True,
        )

    scored = with_parameters(
        sample_df.select("dataset_id", "row_id", "features"),
        model,
        scores,
        "dataset_id string, row_id bigint, cuts int, score double",
    )
    return scored.drop("cuts") if counts is None else scored


def loda_landmarks(model: DataFrame) -> DataFrame:
    """Summaries of mean and largest probability, per bin over cuts and per cut over bins."""
    entries = model.select("dataset_id", "cut", F.posexplode("prob").alias("bin", "prob"))
    per_bin = entries.groupBy("dataset_id", "bin").agg(
        F.avg("prob").alias("LODA_n_hists_mean"), F.max("prob").alias("LODA_n_hists_max")
    )
    per_cut = entries.groupBy("dataset_id", "cut").agg(
        F.avg("prob").alias("LODA_n_cuts_mean"), F.max("prob").alias("LODA_n_cuts_max")
    )
    bins = summaries(per_bin, ("LODA_n_hists_mean", "LODA_n_hists_max"))
    return bins.unionByName(summaries(per_cut, ("LODA_n_cuts_mean", "LODA_n_cuts_max")))
