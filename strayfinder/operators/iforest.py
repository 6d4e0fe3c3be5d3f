"""Isolation forest (Liu et al. 2008).

All choices come from md5 digests of (seed, dataset, tree, node or row), so a forest can be grown again
from its definition, by whatever engine, and doesn't depend on partitions or row order. Nodes are
numbered 1 for the root and 2k, 2k + 1 for the children of k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strayfinder.functions.scalar import summaries
from strayfinder.operators.pairs import matrix
from strayfinder.session import sized, spread, with_parameters

SUBSAMPLE = 256
IFOREST_TREES = 100

_NODE_COLUMNS = ("feature", "threshold", "child", "path", "depth", "gain")
_TREE_SCHEMA = (
    "dataset_id string, tree int, sample_size int, width int, feature array<int>, "
    "threshold array<double>, child array<int>, path array<double>, depth array<int>, "
    "gain array<double>"
)


# Arithmetic of row hashes is modulo this prime, so that products fit 64 bits.
PRIME = 2147483647


def digest(*parts: object) -> str:
    """32 hex digits that depend only on ``parts``."""
    return md5(":".join(map(str, parts)).encode()).hexdigest()


def fraction(digits: str) -> float:
    """13 hex digits as a number in [0, 1)."""
    return int(digits, 16) / float(1 << 52)


def row_digest(row_id: str = "row_id") -> Column:
    """The 16 bytes of the digest of a row's id."""
    return F.unhex(F.md5(F.col(row_id).cast("string")))


def row_halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below PRIME from each row's digest: its first and its second four bytes."""
    start = digests.offset
    words = np.frombuffer(digests.buffers()[2], dtype=">u4").reshape(-1, 4)[start : start + len(digests)]
    return tuple(words[:, k].astype(np.uint64) % np.uint64(PRIME) for k in (0, 1))


def tree_maps(trees: int, seed: int) -> np.ndarray:
    """Per tree the factors and shifts of two linear functions modulo PRIME, one for each half of a row's digest."""
    maps = []
    for tree in range(trees):
        d = digest(seed, tree)
        a1, a2 = (int(d[k : k + 8], 16) % (PRIME - 1) + 1 for k in (0, 16))
        b1, b2 = (int(d[k : k + 8], 16) % PRIME for k in (8, 24))
        maps.append((a1, b1, a2, b2))
    return np.array(maps, dtype=np.uint64).reshape(-1, 4)


def _linear(a: np.uint64, x: np.ndarray, b: np.uint64) -> np.ndarray:
    """(a x + b) modulo PRIME for numbers below it; PRIME is 2^31 - 1, so the high bits are added to the low ones."""
    prime = np.uint64(PRIME)
    y = a * x
    y += b
    high = y >> np.uint64(31)
    y &= prime
    y += high
    np.subtract(y, prime, out=high)  # wraps round below PRIME
    return np.minimum(y, high, out=y)


# Offered rows that a task sends on at a time.
_OFFERED_ROWS = 50_000


def uniform_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends only on the given columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def tree_samples(
    sample_df: DataFrame,
    trees: int = IFOREST_TREES,
    seed: int = 0,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(dataset_id, tree, row_id, features): at most 256 rows per tree, without replacement.

    A tree takes the rows of smallest hash. Which trees a row is offered to is decided row by row,
    independently for every tree, in the scan's own stage: about 400 rows a tree, from all rows, go on.
    """
    if counts is None:
        counts = sample_df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = sized(counts.select("dataset_id", F.col("n_rows").alias("_n")))
    bound = F.least(F.lit(1.0), 400.0 / F.col("_n")) * float(PRIME) * float(PRIME)
    maps = tree_maps(trees, seed)
    kinds = [pa.string(), pa.int64(), pa.list_(pa.field("element", pa.float64())), pa.int32(), pa.int64()]
    names = ["dataset_id", "row_id", "features", "tree", "_u"]

    def chosen(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        at, tree, u = (np.concatenate(part) for part in zip(*found))
        rows = [batch.column(c).take(pa.array(at)) for c in names[:3]]
        columns = [c.cast(kind) for c, kind in zip([*rows, pa.array(tree), pa.array(u)], kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def offer(batches):
        for batch in batches:
            one, two = row_halves(batch.column("_digest"))
            most = batch.column("_bound").to_numpy()
            limit = np.floor(most / PRIME).astype(np.uint64)
            found, size = [], 0
            for tree, (a1, b1, a2, b2) in enumerate(maps):
                first = _linear(a1, one, b1)
                at = np.flatnonzero(first <= limit)
                u = (first[at] * np.uint64(PRIME) + _linear(a2, two[at], b2)).astype(np.int64)
                inside = u <= most[at]
                at, u = at[inside], u[inside]
                found.append((at, np.full(len(at), tree, dtype=np.int32), u))
                size += len(at)
                if size >= _OFFERED_ROWS:
                    yield chosen(batch, found)
                    found, size = [], 0
            if size:
                yield chosen(batch, found)

    offered = (
        sample_df.where(F.col("row_id").isNotNull())
        .select("dataset_id", "row_id", "features", row_digest().alias("_digest"))
        .join(counts, "dataset_id")
        .select("dataset_id", "row_id", "features", "_digest", bound.alias("_bound"))
        .mapInArrow(offer, "dataset_id string, row_id bigint, features array<double>, tree int, _u bigint")
    )
    w = Window.partitionBy("dataset_id", "tree").orderBy("_u", "row_id")
    return (
        offered.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= SUBSAMPLE)
        .select("dataset_id", "tree", "row_id", "features")
    )


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def _grow(x: np.ndarray, features: np.ndarray, target: np.ndarray, name: tuple) -> dict[str, np.ndarray]:
    """One random tree, a whole level at a time.

    Of the features that vary in a node its digest picks one, and the cut. ``child`` is the left child (the right one follows it), -1 at a leaf; ``gain`` is the drop in
    squared error of the random ``target``.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    values = x[:, features]
    node = np.zeros(len(x), dtype=int)
    size = 2 * len(x)
    out = {
        "feature": np.full(size, -1),
        "threshold": np.zeros(size),
        "child": np.full(size, -1),
        "depth": np.zeros(size, dtype=int),
        "number": np.ones(size, dtype=int),
        "count": np.zeros(size),
        "gain": np.zeros(size),
    }
    out["count"][0] = len(x)
    used, rows = 1, np.arange(len(x))

    def squared_error(of: np.ndarray, total: int) -> np.ndarray:
        c = np.bincount(of, minlength=total)
        s = np.bincount(of, weights=target[rows], minlength=total)
        q = np.bincount(of, weights=target[rows] ** 2, minlength=total)
        return q - s * s / np.maximum(c, 1)

    for depth in range(limit):
        rows = rows[np.argsort(node[rows], kind="stable")]
        ids, starts, place = np.unique(node[rows], return_index=True, return_inverse=True)
        low = np.minimum.reduceat(values[rows], starts, axis=0)
        high = np.maximum.reduceat(values[rows], starts, axis=0)
        varies = high > low
        digests = [digest(*name, number) for number in out["number"][ids]]
        wanted = np.floor(np.array([fraction(d[:13]) for d in digests]) * varies.sum(axis=1))
        pick, each = (varies & (np.cumsum(varies, axis=1) == wanted[:, None] + 1)).argmax(axis=1), np.arange(len(ids))
        lo, hi = low[each, pick], high[each, pick]
        cut = lo + np.array([fraction(d[13:26]) for d in digests]) * (hi - lo)
        cut = np.where(cut >= hi, lo, cut)
        splits = hi > lo
        if not splits.any():
            break
        child = np.where(splits, used + 2 * (np.cumsum(splits) - 1), -1)
        before = squared_error(place, len(ids))
        staying = splits[place]
        rows, place = rows[staying], place[staying]
        right = values[rows, pick[place]] > cut[place]
        node[rows] = child[place] + right
        total = used + 2 * int(splits.sum())
        after = squared_error(node[rows], total)
        at, to = ids[splits], child[splits]
        out["feature"][at] = features[pick[splits]]
        out["threshold"][at] = cut[splits]
        out["child"][at] = to
        out["gain"][at] = before[splits] - after[to] - after[to + 1]
        out["depth"][used:total] = depth + 1
        out["number"][to], out["number"][to + 1] = 2 * out["number"][at], 2 * out["number"][at] + 1
        out["count"][used:total] = np.bincount(node[rows], minlength=total)[used:total]
        used = total
    out = {c: v[:used] for c, v in out.items()}
    out["path"] = out["depth"] + average_path(out["count"])
    return out


# Trees grown per Python call; a group holds at most this many subsamples.
_TREES_PER_GROUP = 10


def iforest_fit(
    sample_df: DataFrame,
    trees: int = IFOREST_TREES,
    max_features: float = 1.0,
    seed: int = 0,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per (dataset, tree) with packed node arrays.

    A group is ten trees of one dataset, at most 2,560 rows by construction.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tree", "row_id"])
        all_x = matrix(rows["features"])
        dataset, width = rows["dataset_id"].iloc[0], all_x.shape[1]
        used = max(1, int(max_features * width))
        names, starts = np.unique(rows["tree"].to_numpy(), return_index=True)
        grown = []
        ids = np.split(rows["row_id"].to_numpy(), starts[1:])
        for tree, x, own in zip(names, np.split(all_x, starts[1:]), ids):
            name = (seed, dataset, tree)
            order = sorted(range(width), key=lambda f: digest(*name, "f", f)) if used < width else range(width)
            features = np.sort(np.array(order[:used]))
            target = np.array([fraction(digest(*name, "r", i)[:13]) for i in own])
            nodes = _grow(x, features, target, name)
            grown.append((dataset, tree, len(x), used, *[nodes[c] for c in _NODE_COLUMNS]))
        return pd.DataFrame(
            grown, columns=["dataset_id", "tree", "sample_size", "width", *_NODE_COLUMNS]
        )

    group = F.floor(F.col("tree") / _TREES_PER_GROUP)
    return (
        spread(tree_samples(sample_df, trees, seed, counts).withColumn("_group", group), "dataset_id", "_group")
        .groupBy("dataset_id", "_group")
        .applyInPandas(build, _TREE_SCHEMA)
    )


def iforest_scores(
    sample_df: DataFrame,
    model: DataFrame,
    trees: int | None = None,
    counts: Sequence[int] | None = None,
) -> DataFrame:
    """(dataset_id, row_id, score = 2^(-mean path / c(sample size))), in (0, 1].

    With ``counts``, one scan gives a score for the first t trees of each t, as rows with a column
    ``trees``.
    """

    def scores(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        x = matrix(part["features"])
        index = np.arange(len(x))
        total = np.zeros(len(x))
        wanted = [len(side)] if counts is None else sorted(counts)
        scale = float(average_path(side["sample_size"].max()))
        out = []
        for done, t in enumerate(side.sort_values("tree").itertuples(), 1):
            feature, child = np.asarray(t.feature), np.asarray(t.child)
            threshold, path = np.asarray(t.threshold), np.asarray(t.path)
            node = np.zeros(len(x), dtype=int)
            while True:
                step = child[node]
                moving = step >= 0
                if not moving.any():
                    break
                right = x[index, np.maximum(feature[node], 0)] > threshold[node]
                node = np.where(moving, step + right, node)
            total += path[node]
            if done in wanted:
                out.append(
                    pd.DataFrame(
                        {
                            "dataset_id": part["dataset_id"].iloc[0],
                            "row_id": part["row_id"].to_numpy(),
                            "trees": done,
                            "score": 2.0 ** (-total / done / scale) if scale > 0 else np.full(len(x), 0.5),
                        }
                    )
                )
        return pd.concat(out, ignore_index=True)

    used = model if trees is None else model.where(F.col("tree") < trees)
    scored = with_parameters(
        sample_df.select("dataset_id", "row_id", "features"),
        used.select(
            "dataset_id", "tree", "sample_size", "feature", "threshold", "child", "path"
        ),
        scores,
        "dataset_id string, row_id bigint, trees int, score double",
    )
    return scored.drop("trees") if counts is None else scored


def tree_shapes(model: DataFrame) -> DataFrame:
    """Leaves, depth, mean and largest feature importance of every tree.

    The importance of a feature is its share of the variance reduction of a random target.
    """
    nodes = model.select(
        "dataset_id", "tree", "width", F.inline(F.arrays_zip("feature", "depth", "gain"))
    )
    per_feature = nodes.groupBy("dataset_id", "tree", "width", "feature").agg(
        F.sum("gain").alias("gain"),
        F.count_if(F.col("feature") < 0).alias("leaves"),
        F.max("depth").alias("depth"),
    )
    per_tree = per_feature.groupBy("dataset_id", "tree", "width").agg(
        F.sum("leaves").alias("IForest_n_leaves"),
        F.max("depth").alias("IForest_n_depth"),
        F.sum("gain").alias("_total"),
        F.max("gain").alias("_top"),
    )
    split = F.col("_total") > 0
    return per_tree.select(
        "dataset_id",
        "tree",
        "IForest_n_leaves",
        "IForest_n_depth",
        F.when(split, 1.0 / F.col("width")).otherwise(0.0).alias("IForest_fi_mean"),
        F.when(split, F.col("_top") / F.col("_total")).otherwise(0.0).alias("IForest_fi_max"),
    )


IFOREST_BLOCKS = ("IForest_n_leaves", "IForest_n_depth", "IForest_fi_mean", "IForest_fi_max")


def iforest_landmarks(model: DataFrame) -> DataFrame:
    return summaries(tree_shapes(model), IFOREST_BLOCKS)
