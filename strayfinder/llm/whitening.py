"""Embedding whitening by spectrum slicing.

Entries become whole numbers, ``floor(64 * c) + 1000000``, so counts, sums and products over the distinct
vectors are exact and do not depend on the order of tasks. The covariance (dimension squared numbers,
whatever the rows) comes to the driver. There the inertia of LDL^T factors of the shifted matrix counts
the eigenvalues above a shift; bisection on those counts isolates each leading eigenvalue, Rayleigh
quotient iteration, which converges cubically, gives it with its vector, and counts on both sides of the
result certify its number. Vectors are orthogonal to those found before, so equal eigenvalues get a basis.

Copies of a vector collapse before the shuffle, which carries packed whole numbers. Every task sends one
row per pair of dimensions; those are summed in a shuffle before the driver sees them.

Defined results: vectors that are null, hold null, NaN or infinite entries, or entries whose whole number
is no long, are dropped, and so are those of another length than the most frequent one (of equally
frequent lengths the smallest counts); ids may be null or repeat and keep their type; directions without
variance have no component, so one distinct vector, or none, gives no rows; a deviation beyond a long is
null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strayfinder.session import durable

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
CHUNK = 8192
#: fixed value: the pivot bound (1 + sqrt(17)) / 8 that keeps the growth of LDL^T factors smallest
PIVOT = (1 + 17**0.5) / 8


# --- spectrum slicing -----------------------------------------------------------------------------


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of the shifted LDL^T factors.

    By Sylvester's law of inertia the blocks of D have the signs of the spectrum. Pivots are the largest
    diagonal entry or, where an entry beside the diagonal is much larger, a block of two, which has one
    eigenvalue of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        beside = np.abs(np.triu(a, 1))
        r, s = np.unravel_index(int(beside.argmax()), a.shape)
        if beside[r, s] == 0 and diagonal[p] == 0:
            return positive
        if diagonal[p] >= PIVOT * beside[r, s]:
            keep = np.arange(len(a)) != p
            positive += int(a[p, p] > 0)
            column = a[keep, p]
            a = a[np.ix_(keep, keep)] - np.outer(column, column) / a[p, p]
        else:
            keep = np.ones(len(a), bool)
            keep[[r, s]] = False
            positive += 1
            columns = a[np.ix_(keep, [r, s])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(a[np.ix_([r, s], [r, s])], columns.T)
        a = (a + a.T) / 2
    return positive


@dataclass
class Spectrum:
    """Leading eigenvalues, falling, and their unit vectors as columns; certified: the counts agree."""

    values: np.ndarray
    vectors: np.ndarray
    certified: bool


def _solve(a: np.ndarray, shift: float, v: np.ndarray, unit: float) -> np.ndarray:
    """(a - shift) x = v; a shift that meets an eigenvalue exactly is moved by a rounding error."""
    while True:
        try:
            x = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            x = np.full(len(a), np.inf)
        if np.all(np.isfinite(x)):
            return x
        shift += unit


def _clear(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """The unit vector along ``v`` without the directions found before."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
        v = v / max(float(np.linalg.norm(v)), np.finfo(float).tiny)
    return v


def leading(matrix: np.ndarray, most: int) -> Spectrum:
    """The ``most`` largest eigenvalues that differ from zero, by slicing."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if norm == 0:
        return Spectrum(np.empty(0), np.empty((d, 0)), True)
    a = matrix / norm
    unit = d * np.finfo(float).eps
    counts = {-1.0 - unit: d, 1.0 + unit: 0}  # by Gershgorin all eigenvalues lie between

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    certified = True
    rng = np.random.default_rng(d)
    for k in range(1, min(most, count(unit)) + 1):
        low = max(s for s, c in counts.items() if c >= k)
        high = min(s for s, c in counts.items() if c < k)
        start = _clear(rng.normal(size=d), vectors)
        while True:
            middle = (low + high) / 2
            alone = counts[low] == k and counts[high] == k - 1
            if alone or high - low <= 4 * unit:
                v = start
                for _ in range(2):  # inverse iteration into the interval
                    v = _clear(_solve(a, middle, v, unit), vectors)
                rho = float(v @ a @ v)
                for _ in range(12):
                    if np.linalg.norm(a @ v - rho * v) <= unit / 8:
                        break
                    v = _clear(_solve(a, rho, v, unit / d), vectors)
                    rho = float(v @ a @ v)
                slack = max(16 * unit, 2 * float(np.linalg.norm(a @ v - rho * v)))
                sure = count(rho - slack) >= k and count(rho + slack) < k
                if sure or high - low <= 4 * unit:
                    break
            if count(middle) >= k:
                low = middle
            else:
                high = middle
        certified &= sure
        values.append(rho * norm)
        vectors.append(v)
    return Spectrum(np.array(values), np.array(vectors).reshape(-1, d).T, certified)


# --- exact sums over the distinct vectors ---------------------------------------------------------


def usable(rows: DataFrame, vec_col: str, id_col: str | None = None) -> DataFrame:
    """([id,] v): vectors whose entries are all finite and stand for longs."""
    v = rows[vec_col].cast("array<double>")
    inside = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**56))
    keys = [] if id_col is None else [rows[id_col].alias("id")]
    return rows.where(v.isNotNull() & inside).select(*keys, v.alias("v"))


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers without the shift, which cancels wherever vectors are centred."""
    return np.floor(SCALE * values).astype(np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    column = batch.column("v")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[begin[at][:, None] + np.arange(d)[None, :]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, packed): entries in the narrowest of two, four or eight bytes that holds all of the vector's."""
    for batch in batches:
        for at, values in _by_length(batch):
            if values.shape[1] == 0:
                continue
            z = _whole(values)
            high = np.maximum(z.max(axis=1), -1 - z.min(axis=1))
            packed = np.empty(len(at), dtype=object)
            for kind, low, top in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
                rows = np.flatnonzero((high >= low) & (high <= top - 1))
                raw = z[rows].astype(kind)
                packed[rows] = [r.tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), z.shape[1]), pa.int32()), pa.array(list(packed), pa.binary())], names=["d", "packed"]
            )


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Matrices of whole numbers, at most ``CHUNK`` rows each."""
    column = batch.column("packed")
    if not len(column):
        return
    d = batch.column("d")[0].as_py()
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for width in (2, 4, 8):
        rows = column.filter(pa.array(lengths == width * d))
        for start in range(0, len(rows), CHUNK):
            part = rows.slice(start, CHUNK).to_pylist()
            yield np.frombuffer(b"".join(part), f"<i{width}").reshape(-1, d).astype(np.int64)


def _summed(terms: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(terms)), pa.int32()), pa.array([Decimal(int(x)) for x in terms], pa.decimal128(38, 0))],
        names=["k", "s"],
    )


def _collected(sums: DataFrame, size: int) -> list[int]:
    """Totals of ``size`` numbers; as many rows reach the driver, whatever the tasks sent."""
    out = [0] * size
    for row in sums.groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[row["k"]] = int(row["s"])
    return out


@dataclass
class Whitening:
    """Fitted state: counts and exact sums, and the leading components.

    A centred entry is (n * (z - centre) - rest) / n, where z is an entry's whole number.
    """

    dimension: int
    n: int
    centre: np.ndarray
    rest: np.ndarray
    trace: float
    spectrum: Spectrum

    def scaled(self, z: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they hold it and Python integers elsewhere."""
        near = z - self.centre
        widest = max(int(np.abs(near).max(initial=0)), 1)
        rest = max((abs(int(r)) for r in self.rest), default=0)
        if self.n * widest + rest < 1 << 62:
            return self.n * near - self.rest.astype(np.int64)
        return self.n * near.astype(object) - self.rest

    def apply(self, t: np.ndarray) -> np.ndarray:
        """Whitened rows from n * x - S."""
        centred = (t / self.n).astype(float)
        return centred @ self.spectrum.vectors / np.sqrt(self.spectrum.values)


def distinct(rows: DataFrame, vec_col: str) -> DataFrame:
    """(d, packed, copies): every distinct vector once, written to the checkpoint folder."""
    packed = usable(rows, vec_col).mapInArrow(_pack, "d int, packed binary")
    return durable(packed.groupBy("d", "packed").agg(F.count("*").alias("copies")))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Components of the most frequent length's distinct vectors; None without vectors."""
    lengths = vectors.groupBy("d").agg(F.sum("copies").alias("rows"), F.count("*").alias("n"))
    chosen = lengths.orderBy(F.desc("rows"), "d").first()
    if chosen is None:
        return None
    d, n = chosen["d"], chosen["n"]
    own = vectors.where(F.col("d") == d).select("d", "packed")

    def totals(batches):
        total = np.zeros(d, dtype=object)
        for batch in batches:
            for z in _unpacked(batch):  # in halves, whose sums fit longs
                total = total + (z >> 32).sum(axis=0).astype(object) * (1 << 32) + (z & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield _summed(total)

    sums = _collected(own.mapInArrow(totals, "k int, s decimal(38,0)"), d)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    upper = np.triu_indices(d)

    def products(batches):
        total = np.zeros(len(upper[0]), dtype=object)
        for batch in batches:
            for z in _unpacked(batch):
                near = z - centre
                widest = int(np.abs(near).max(initial=0))
                if widest * widest * len(near) < 1 << 53:  # exact in doubles
                    gram = (near.T.astype(float) @ near.astype(float)).astype(np.int64)
                else:
                    gram = near.T.astype(object) @ near.astype(object)
                total = total + gram[upper].astype(object)
        yield _summed(total)

    pairs = _collected(own.mapInArrow(products, "k int, s decimal(38,0)"), len(upper[0]))
    covariance = np.empty((d, d))
    for i, j, p in zip(*upper, pairs):
        covariance[i, j] = covariance[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    return Whitening(d, n, centre, rest, float(np.trace(covariance)), leading(covariance, most))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened distinct vectors' covariance minus the identity."""
    m = len(model.spectrum.values)
    size = m + m * m

    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            for z in _unpacked(batch):
                w = model.apply(model.scaled(z))
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "s"])

    own = vectors.where(F.col("d") == model.dimension).select("d", "packed")
    total = np.zeros(size)
    for row in own.mapInArrow(sums, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        total[row["k"]] = row["s"]
    mean = total[:m] / model.n
    return float(np.abs(total[m:].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    vectors = distinct(rows, vec_col)
    model = fit(vectors, most)
    found = usable(rows, vec_col, id_col)
    kind = found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    m = 0 if model is None else len(model.spectrum.values)
    if m == 0:
        return rows.sparkSession.createDataFrame([], schema)
    if not model.spectrum.certified:
        raise ArithmeticError("the counts on both sides of an eigenvalue do not confirm its number")
    error = identity_error(vectors, model)
    explained = model.spectrum.values / model.trace

    def long_sums(t: np.ndarray) -> pa.Array:
        widest = max((abs(int(x)) for x in (t.max(initial=0), t.min(initial=0))), default=0)
        if widest * widest * t.shape[1] < 1 << 63:
            return pa.array((t * t).sum(axis=1).astype(np.int64), pa.int64())
        whole = (t.astype(object) ** 2).sum(axis=1)
        return pa.array([int(x) if x < 1 << 63 else None for x in whole], pa.int64())

    def out(batches):
        for batch in batches:
            for at, values in _by_length(batch):
                for start in range(0, len(at), CHUNK):
                    part = slice(start, start + CHUNK)
                    t = model.scaled(_whole(values[part]))
                    count = len(t)
                    repeated = pa.array(np.repeat(np.arange(count), m))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(np.repeat(at[part], m))),
                            pa.array(np.tile(np.arange(1, m + 1), count), pa.int32()),
                            pa.array(np.full(count * m, model.n), pa.int64()),
                            long_sums(t).take(repeated),
                            pa.array(model.apply(t).ravel()),
                            pa.array(np.tile(explained, count)),
                            pa.array(np.full(count * m, error)),
                        ],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return found.where(F.size("v") == model.dimension).mapInArrow(out, schema)
