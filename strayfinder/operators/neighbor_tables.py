"""Scores of many settings from lists of neighbours, looked up in broadcast tables instead of by shuffles.

``pack`` turns an edge table into blocks of rows with as many neighbours each, as bytes; a row is its place
among the sorted ids of its dataset. What a detector needs of the neighbours (distances to the k-th one,
densities, chaining distances, features) is then an array by place, sent to all tasks while it is small.
Where ids repeat or are missing, or there are too many rows, ``pack`` gives None and the joins of
``neighbors`` do the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from strayfinder.operators import neighbors
from strayfinder.session import SMALL_BYTES, dataset_arrays, durable

_KEYS = ("dataset_id", "row_id")
_BLOCK_SCHEMA = "dataset_id string, size int, at binary, wanted binary, dists binary, nbrs binary"
_VALUE_SCHEMA = "dataset_id string, at binary, found binary"
_SCORE_SCHEMA = "dataset_id string, row_id bigint, found array<double>"
# Rows of a block.
PACKED_ROWS = 2048


@dataclass
class Lists:
    """Packed neighbours of all rows, and the sorted ids of every dataset; ``wanted`` rows are scored."""

    blocks: DataFrame
    ids: Broadcast
    rows: int
    datasets: dict[str, int]

    def fits(self, numbers: int) -> bool:
        """If a table of so many numbers a row may be sent to every task."""
        return 8 * numbers * self.rows <= SMALL_BYTES

    def table(self, found: DataFrame) -> Broadcast:
        """Arrays by place from ``_VALUE_SCHEMA`` rows; NaN for rows without any."""
        out: dict[str, np.ndarray] = {}
        for dataset, at, values in zip(*(c.to_pylist() for c in found.toArrow().columns)):
            at, values = np.frombuffer(at, np.int32), np.frombuffer(values)
            if dataset not in out:
                out[dataset] = np.full((self.datasets[dataset], len(values) // len(at)), np.nan)
            out[dataset][at] = values.reshape(len(at), -1)
        return found.sparkSession.sparkContext.broadcast(out)

    def values(self, fn: Callable) -> DataFrame:
        """``fn(dataset, places, distances, neighbours)`` of all rows, a row of numbers each, by place."""

        def scan(batches):
            for dataset, at, _, dists, nbrs in _unpacked(batches):
                yield _batch([(dataset, at.tobytes(), np.ascontiguousarray(fn(dataset, at, dists, nbrs), dtype=float).tobytes())], _VALUE_SCHEMA)

        return self.blocks.mapInArrow(scan, _VALUE_SCHEMA)

    def scores(self, models: dict[int, int], fn: Callable) -> DataFrame:
        """(dataset_id, row_id, model_id, score) of the wanted rows; ``models`` are columns of what ``fn`` gives."""
        ids = self.ids

        def scan(batches):
            for dataset, at, wanted, dists, nbrs in _unpacked(batches):
                if not wanted.any():
                    continue
                found = fn(dataset, at[wanted], dists[wanted], nbrs[wanted])
                flat = pa.array(np.ascontiguousarray(found, dtype=float).ravel(), from_pandas=True)
                starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                names, rows = pa.array([dataset] * len(found)), pa.array(ids.value[dataset][at[wanted]])
                yield pa.RecordBatch.from_arrays(
                    [names, rows, pa.ListArray.from_arrays(starts, flat)], names=["dataset_id", "row_id", "found"]
                )

        wide = self.blocks.mapInArrow(scan, _SCORE_SCHEMA)
        return neighbors._exploded(wide, {m: F.col("found")[j] for m, j in models.items()})


def _batch(found: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*found), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _unpacked(batches) -> Iterator[tuple]:
    """(dataset, places, wanted, distances, neighbours) of blocks; the last two have a row per place."""
    for batch in batches:
        names, sizes = (batch.column(c).to_pylist() for c in ("dataset_id", "size"))
        at, wanted, dists, nbrs = (batch.column(c) for c in ("at", "wanted", "dists", "nbrs"))
        for i, (dataset, size) in enumerate(zip(names, sizes)):
            yield (
                dataset, np.frombuffer(at[i].as_buffer(), np.int32), np.frombuffer(wanted[i].as_buffer(), bool),
                np.frombuffer(dists[i].as_buffer()).reshape(-1, size),
                np.frombuffer(nbrs[i].as_buffer(), np.int32).reshape(-1, size),
            )


def _places(rows: DataFrame) -> dict[str, np.ndarray] | None:
    """Sorted ids of every dataset; None where they repeat or are missing, or are too many."""
    if rows.where(F.col("dataset_id").isNull() | F.col("row_id").isNull()).limit(1).count() or 8 * rows.count() > SMALL_BYTES:
        return None

    def scan(batches):
        for batch in batches:
            names = batch.column("dataset_id").dictionary_encode()
            codes, ids = names.indices.to_numpy(), batch.column("row_id").to_numpy()
            for code, dataset in enumerate(names.dictionary.to_pylist()):
                yield _batch([(dataset, ids[codes == code].tobytes())], "dataset_id string, ids binary")

    held: dict[str, list] = {}
    for dataset, ids in zip(*(c.to_pylist() for c in rows.select(*_KEYS).mapInArrow(scan, "dataset_id string, ids binary").toArrow().columns)):
        held.setdefault(dataset, []).append(np.frombuffer(ids, np.int64))
    out = {dataset: np.sort(np.concatenate(parts)) for dataset, parts in held.items()}
    return out if all((np.diff(ids) > 0).all() for ids in out.values()) else None


def pack(edges: DataFrame, rows: DataFrame, asked: DataFrame | None = None) -> Lists | None:
    """The edges of ``rows`` as lists, written once; scores are asked of the rows ``asked``, or of all."""
    places = _places(rows)
    if places is None:
        return None
    ids = rows.sparkSession.sparkContext.broadcast(places)
    near = F.sort_array(F.collect_list(F.struct("rank", "dist", "nbr_id")))
    lists = edges.groupBy(*_KEYS).agg(near.alias("_near"))
    if asked is None:
        lists = lists.withColumn("wanted", F.lit(True))
    else:
        mark = asked.select(*_KEYS).distinct().withColumn("_asked", F.lit(True))
        lists = lists.join(mark, list(_KEYS), "left").withColumn("wanted", F.col("_asked").isNotNull())

    def scan(batches):
        for batch in batches:
            names = batch.column("dataset_id").dictionary_encode()
            codes, own = names.indices.to_numpy(), batch.column("row_id").to_numpy()
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            dists, nbrs = batch.column("dists"), batch.column("nbrs")
            starts = dists.offsets.to_numpy()
            sizes, low = np.diff(starts), starts[0]
            dists, nbrs = dists.flatten().to_numpy(), nbrs.flatten().to_numpy()
            for code, size in sorted(set(zip(codes.tolist(), sizes.tolist()))):
                of, dataset = np.flatnonzero((codes == code) & (sizes == size)), names.dictionary[code].as_py()
                known = ids.value[dataset]
                for first in range(0, len(of), PACKED_ROWS):
                    part = of[first : first + PACKED_ROWS]
                    cells = starts[part][:, None] - low + np.arange(size)
                    yield _batch([(
                        dataset, size, np.searchsorted(known, own[part]).astype(np.int32).tobytes(), wanted[part].tobytes(),
                        dists[cells].tobytes(), np.searchsorted(known, nbrs[cells]).astype(np.int32).tobytes(),
                    )], _BLOCK_SCHEMA)

    lists = lists.select(*_KEYS, "wanted", F.col("_near.dist").alias("dists"), F.col("_near.nbr_id").alias("nbrs"))
    sizes = {dataset: len(known) for dataset, known in places.items()}
    return Lists(durable(lists.mapInArrow(scan, _BLOCK_SCHEMA)), ids, sum(sizes.values()), sizes)


# --------------------------------------------------------------------------- detectors


def knn_scores_all(lists: Lists, models: dict[int, tuple[int, str]]) -> DataFrame:
    """``neighbors.knn_scores_all`` from lists."""
    fold = {"largest": lambda d: d[:, -1], "mean": lambda d: d.mean(axis=1), "median": lambda d: np.median(d, axis=1)}
    settings = list(models.values())

    def scores(dataset, at, dists, nbrs):
        return np.stack([fold[method](dists[:, :k]) for k, method in settings], axis=1)

    return lists.scores({m: j for j, m in enumerate(models)}, scores)


def lof_scores_all(lists: Lists, models: dict[int, int]) -> list[DataFrame] | None:
    """``neighbors.lof_scores_all`` from lists, in parts of as many k as their tables may be sent; None if not one's may."""
    every = sorted(set(models.values()))
    together = len(every)
    while together and not lists.fits(together):
        together -= 1
    if not together:
        return None
    parts = [every[low : low + together] for low in range(0, len(every), together)]
    return [_lof(lists, ks, {m: k for m, k in models.items() if k in ks}) for ks in parts]


def _lof(lists: Lists, ks: list[int], models: dict[int, int]) -> DataFrame:
    reached = lists.table(lists.values(
        lambda dataset, at, dists, nbrs: np.stack([dists[:, :k][:, -1] for k in ks], axis=1)
    ))

    def densities(dataset, at, dists, nbrs):
        found = reached.value[dataset]
        return np.stack([
            1.0 / (np.maximum(dists[:, :k], found[:, j][nbrs[:, :k]]).mean(axis=1) + 1e-10) for j, k in enumerate(ks)
        ], axis=1)

    density = lists.table(lists.values(densities))

    def scores(dataset, at, dists, nbrs):
        found = density.value[dataset]
        around = np.stack([found[:, j][nbrs[:, :k]].mean(axis=1) for j, k in enumerate(ks)], axis=1)
        return around / found[at]

    return lists.scores({m: ks.index(k) for m, k in models.items()}, scores)


def features(lists: Lists, rows: DataFrame) -> Broadcast | None:
    """Features by place; None if they are too many to be sent."""
    if not lists.fits(rows.agg(F.max(F.size("features"))).first()[0] or 0):
        return None
    ids = lists.ids

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                for dataset, part in dataset_arrays(pa.Table.from_batches([batch])):
                    at = np.searchsorted(ids.value[dataset], part["row_id"]).astype(np.int32)
                    yield _batch([(dataset, at.tobytes(), part["features"].tobytes())], _VALUE_SCHEMA)

    return lists.table(rows.select(*_KEYS, "features").mapInArrow(scan, _VALUE_SCHEMA))


def _by_vectors(fn: Callable, vectors: Broadcast, ks: list[int]) -> Callable:
    def found(dataset, at, dists, nbrs):
        x, most = vectors.value[dataset], min(ks[-1], nbrs.shape[1])
        step = max(1, neighbors._BATCH_CELLS // (most * max(most, x.shape[1])))
        return np.concatenate([
            fn(x[at[low : low + step]], x[nbrs[low : low + step, :most]], [min(k, most) for k in ks])
            for low in range(0, len(at), step)
        ])

    return found


def abod_scores_all(lists: Lists, vectors: Broadcast, models: dict[int, int]) -> DataFrame:
    """``neighbors.abod_scores_all`` from lists."""
    ks = sorted(set(models.values()))
    return lists.scores({m: ks.index(k) for m, k in models.items()}, _by_vectors(neighbors._angle_variances, vectors, ks))


def cof_scores_all(lists: Lists, vectors: Broadcast, models: dict[int, int]) -> DataFrame | None:
    """``neighbors.cof_scores_all`` from lists; None if the chaining distances are too many to be sent."""
    ks = sorted(set(models.values()))
    if not lists.fits(len(ks)):
        return None
    chains = lists.table(lists.values(_by_vectors(neighbors._chaining_distances, vectors, ks)))

    def scores(dataset, at, dists, nbrs):
        found = chains.value[dataset]
        around = np.stack([found[:, j][nbrs[:, :k]].mean(axis=1) for j, k in enumerate(ks)], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(around == 0, 0.0, found[at] / around)

    return lists.scores({m: ks.index(k) for m, k in models.items()}, scores)
