"""One-class support vector machine (Schoelkopf et al. 2001), solved to a stated duality gap.

The dual asks for the point of smallest norm among weighted means of the mapped rows, no row
weighing more than 1 / (nu n). Frank-Wolfe steps need the mean of the nu n rows with the lowest scores.
One scan per pass finds it for all nu: every row falls into a bin of its score, and counts and sums per
bin give that mean up to the width of one bin, which narrows from pass to pass around the quantile. The
new mean joins the ones found before, and the point of smallest norm among all their mixtures is exact
(Wolfe 1976), so steps never zigzag. The gap between the point and the best possible step, the bin's
width included, bounds how far the solution is from the optimum; passes end when it is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strayfinder.operators.iforest import uniform_hash
from strayfinder.operators.pairs import matrix
from strayfinder.session import (
    STATE_CELLS,
    dataset_arrays,
    durable,
    gathered,
    running_sums,
    sized,
    spread,
    with_parameters,
)

# Landmark rows of the kernel approximation (Williams and Seeger 2001) per doubling of the rows.
LANDMARK_RATE = 32
# Gap, as a share of the squared norm, at which a solution is done, and passes that may reach it.
GAP = 1e-3
PASSES = 200
# Least squared norm, as a share of the largest mapped row's, that a gap is measured by: where the origin
# lies among the means the solution is 0.
FLOOR = 1e-6
# Bins of the scores between the two open ones.
BINS = 14
DEGREE = 3
# Mapped coordinates up to which rows are mapped once, before the passes, instead of in each.
NARROW = 32
# Rows of a packed block, and rows whose kernel values are worked on at a time.
PACKED_ROWS, CHUNK_ROWS = 4096, 512
# Numbers (rows times landmarks, or times coordinates) of a dataset that is solved in one task.
LOCAL_NUMBERS = 8_000_000
# Numbers that the driver holds as maps and states, counting this many means found per nu.
DRIVER_NUMBERS, _ATOMS = 16_000_000, 64

_MODEL_SCHEMA = "dataset_id string, width int, landmarks array<double>, map array<double>, size int"
_STATE_SCHEMA = "dataset_id string, w array<double>, gap array<double>, worst array<double>"
_PACKED_SCHEMA = "dataset_id string, n bigint, radius double, x binary"
_TALLY_SCHEMA = "dataset_id string, j int, s binary"


def _kernel(x: np.ndarray, y: np.ndarray, kernel: str) -> np.ndarray:
    gamma = 1.0 / x.shape[1]
    if kernel == "rbf":
        d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
        d -= 2.0 * (x @ y.T)
        np.maximum(d, 0.0, out=d)
        d *= -gamma
        return np.exp(d, out=d)
    product = gamma * (x @ y.T)
    return product**DEGREE if kernel == "poly" else np.tanh(product)


def _mapped(x: np.ndarray, side: pd.DataFrame, kernel: str) -> np.ndarray:
    """Rows in feature space: themselves for the linear kernel, else landmark coordinates."""
    if kernel == "linear":
        return x
    marks = np.asarray(side["landmarks"].iloc[0], dtype=float).reshape(-1, x.shape[1])
    to = np.asarray(side["map"].iloc[0], dtype=float).reshape(len(marks), -1)
    return _kernel(x, marks, kernel) @ to


def _start(sample_df: DataFrame, kernel: str, seed: int, landmarks: int | None) -> DataFrame:
    """Landmarks, feature map and the number of mapped coordinates, per dataset.

    ``landmarks`` defaults to LANDMARK_RATE times the binary logarithm of a dataset's rows. Rows are
    offered by hash before any are ranked, so a dataset ranks about twice as many as it keeps.
    """
    sizes = sized(sample_df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n")))
    count = F.ceil(F.log2(F.col("_n") + 1.0) * LANDMARK_RATE) if landmarks is None else F.lit(landmarks)
    w = Window.partitionBy("dataset_id").orderBy("_u", "row_id")
    marks = (
        sample_df.select("dataset_id", "row_id", "features")
        .withColumn("_u", uniform_hash(F.lit(seed), F.lit("landmark"), "row_id"))
        .join(sizes, "dataset_id")
        .withColumn("_k", count)
        .where(F.col("_u") * F.col("_n") < 2 * F.col("_k") + 64)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= F.col("_k"))
        .drop("_n", "_k")
    )

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows.sort_values("_r")["features"])
        side = {"landmarks": [[]], "map": [[]]}
        if kernel != "linear":
            values, vectors = np.linalg.eigh(_kernel(x, x, kernel))
            # kernels that are not positive definite keep their positive part
            used = values > 1e-8 * max(values.max(), 1e-300)
            to = vectors[:, used] / np.sqrt(values[used])
            side = {"landmarks": [x.ravel().tolist()], "map": [to.ravel().tolist()]}
        side = pd.DataFrame({"dataset_id": rows["dataset_id"].iloc[0], "width": [x.shape[1]], **side})
        return side.assign(size=_mapped(x[:1], side, kernel).shape[1])

    return marks.groupBy("dataset_id").applyInPandas(build, _MODEL_SCHEMA)


def smallest_norm(atoms: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shares of the mixture of ``atoms`` with the smallest norm, from a start that has the last at 0.

    Wolfe's minor cycles: the point of smallest norm of the affine hull, or the border on the way to it,
    where an atom drops out.
    """
    shares = shares.copy()
    used = shares > 0
    used[-1] = True
    while True:
        at = np.flatnonzero(used)
        gram = atoms[at] @ atoms[at].T
        scale = max(float(np.trace(gram)), 1e-300) / len(at)
        system = np.block([[gram / scale, np.ones((len(at), 1))], [np.ones((1, len(at))), np.zeros((1, 1))]])
        target = np.zeros(len(at) + 1)
        target[-1] = 1.0
        best = np.linalg.lstsq(system, target, rcond=None)[0][:-1]
        now = shares[at]
        falling = best <= 1e-12
        if not falling.any():
            shares[at] = best
            return shares / shares.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(falling & (now > best), now / (now - best), np.inf)
        reach = min(1.0, float(part.min()))
        now = now + reach * (best - now)
        gone = falling & (now <= 1e-12)
        if not gone.any():
            gone[int(part.argmin())] = True
        now[gone] = 0.0
        shares[at] = now
        used[at[gone]] = False
        if used.sum() <= 1:
            shares[:] = used
            return shares


def _fixed(row) -> dict:
    """A dataset's landmarks and map as matrices; none where the packed rows are mapped already."""
    if row["size"] <= NARROW or not len(row["map"]):
        return {"marks": None, "to": None}
    marks = np.asarray(row["landmarks"], dtype=float).reshape(-1, row["width"])
    return {"marks": marks, "to": np.asarray(row["map"], dtype=float).reshape(len(marks), -1)}


def _packed(rows: DataFrame, base: DataFrame, kernel: str) -> DataFrame:
    """(dataset_id, n, radius, x): blocks of rows as bytes, written once for all passes.

    Where a row has few mapped coordinates, these are kept; ``radius`` is the largest norm of a mapped row.
    """

    def blocks(x: np.ndarray, side: pd.DataFrame) -> Iterator[tuple[int, float, bytes]]:
        mapped = side["size"].iloc[0] <= NARROW
        for low in range(0, len(x), PACKED_ROWS):
            part, kept, radius = x[low : low + PACKED_ROWS], [], []
            for start in range(0, len(part), CHUNK_ROWS):
                phi = _mapped(part[start : start + CHUNK_ROWS], side, kernel)
                radius.append(np.sqrt((phi * phi).sum(axis=1).max()))
                kept.append(phi if mapped else part[start : start + CHUNK_ROWS])
            yield len(part), float(np.max(radius)), np.concatenate(kept).tobytes()

    def whole(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(blocks(matrix(part["features"]), side), columns=["n", "radius", "x"])
        found.insert(0, "dataset_id", part["dataset_id"].iloc[0])
        return found

    def folded(batches, side_of):
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary())
        for batch in gathered(batches):
            for dataset, part in dataset_arrays(batch):
                yield _batch([(dataset, *block) for block in blocks(part["features"], side_of(dataset))], _PACKED_SCHEMA, kinds)

    packed = with_parameters(rows, base, whole, _PACKED_SCHEMA, folded=folded)
    # dealt out in turn, the blocks keep all cores busy whichever datasets are still open
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return durable(packed.repartition(tasks))


def _batch(found: list[tuple], schema: str, kinds: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def _values(x: np.ndarray, marks: np.ndarray | None, kernel: str) -> Iterator[np.ndarray]:
    """Packed rows in chunks that stay in cache: as they are if these are mapped, else their kernel values.

    Maps are linear in the kernel values, so weights are mapped before and sums behind the scan.
    """
    for start in range(0, len(x), CHUNK_ROWS):
        part = x[start : start + CHUNK_ROWS]
        yield part if marks is None else _kernel(part, marks, kernel)


def _open(held: dict, fixed: dict, gap: float) -> dict | None:
    """What a scan needs of one dataset: the nu whose gap is not reached; None without any.

    A gap that is no number, of rows with missing values, will not become one and counts as reached.
    """
    nus = np.array([j for j, left in enumerate(held["gap"]) if left > gap], dtype=int)
    if not len(nus):
        return None
    w = np.asarray(held["w"], dtype=float).reshape(len(held["gap"]), -1)[nus]
    low, step = (np.asarray(held[c], dtype=float)[nus] for c in ("low", "step"))
    columns = w.T if fixed["to"] is None else fixed["to"] @ w.T
    return {"nus": nus, "columns": columns, "low": low, "step": step, "marks": fixed["marks"]}


def _tally(state, chunks: Iterator[np.ndarray], side: dict):
    """Counts and sums per open nu and score bin, and least and largest scores, with these rows added."""
    columns, low, step, bins = side["columns"], side["low"], side["step"], BINS + 2
    m = columns.shape[1]
    if state is None:
        state = np.zeros((m, bins, len(columns) + 1)), np.full((m, 2), -np.inf)
    sums, ends = state
    for values in chunks:
        scores = values @ columns
        place = np.clip(np.floor((scores - low) / step) + 1, 0, bins - 1).astype(int)
        for j in range(m):
            of = (place[:, j, None] == np.arange(bins)).astype(float)
            sums[j, :, 0] += of.sum(axis=0)
            sums[j, :, 1:] += of.T @ values
        np.maximum(ends, np.stack([-scores.min(axis=0), scores.max(axis=0)], axis=1), out=ends)
    return state


def _tallied(dataset: str, state, side: dict) -> list[tuple]:
    """Rows of ``_TALLY_SCHEMA``, one per open nu."""
    sums, ends = state
    return [
        (dataset, int(j), np.concatenate([ends[at], sums[at].ravel()]).tobytes()) for at, j in enumerate(side["nus"])
    ]


def _sum(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.r_[np.maximum(one[:2], other[:2]), one[2:] + other[2:]]


def _added(tallies: pd.DataFrame) -> pd.DataFrame:
    """The tallies of one nu of one dataset as one."""
    return tallies.iloc[:1].assign(s=[reduce(_sum, map(np.frombuffer, tallies["s"])).tobytes()])


def _scan(packed: DataFrame, sides: dict, kernel: str) -> DataFrame:
    """Tallies of every task for the datasets of ``sides``, which are broadcast; other rows are passed over."""
    shared = packed.sparkSession.sparkContext.broadcast(sides)
    kinds = (pa.string(), pa.int32(), pa.binary())

    def emitted(states: dict) -> pa.RecordBatch:
        return _batch([row for d, s in states.items() for row in _tallied(d, s, shared.value[d])], _TALLY_SCHEMA, kinds)

    def scan(batches):
        states: dict = {}
        for batch in batches:
            counts, blocks = batch.column("n").to_pylist(), batch.column("x")
            for i, dataset in enumerate(batch.column("dataset_id").to_pylist()):
                side = shared.value.get(dataset)
                if side is None:
                    continue
                x = np.frombuffer(blocks[i].as_buffer()).reshape(counts[i], -1)
                states[dataset] = _tally(states.get(dataset), _values(x, side["marks"], kernel), side)
            if sum(s.size for s, _ in states.values()) > STATE_CELLS:
                yield emitted(states)
                states = {}
        if states:
            yield emitted(states)

    return packed.select("dataset_id", "n", "x").mapInArrow(scan, _TALLY_SCHEMA)


def _started(size: int, m: int) -> dict:
    return {
        "w": [0.0] * (size * m), "low": [-1.0] * m, "step": [1.0] * m, "gap": [float("inf")] * m,
        "atoms": [[] for _ in range(m)], "shares": [[] for _ in range(m)],
    }


def _advance(held: dict, tallies: dict[int, np.ndarray], nus: list[float], fixed: dict, radius: float, gap: float) -> None:
    """Move the state of one dataset on by one pass, from its tallies by position of nu."""
    bins, size = BINS + 2, len(held["w"]) // len(nus)
    for j, tally in tallies.items():
        lowest, highest = -tally[0], tally[1]
        table = tally[2:].reshape(bins, -1)
        counts, sums_ = table[:, 0], table[:, 1:]
        sums_ = sums_ if fixed["to"] is None else sums_ @ fixed["to"]
        low, step = held["low"][j], held["step"][j]
        atoms = np.asarray(held["atoms"][j], dtype=float).reshape(-1, size)
        shares = np.asarray(held["shares"][j], dtype=float)
        mass = nus[j] * counts.sum()
        total = np.cumsum(counts)
        b = min(int(np.searchsorted(total, mass * (1 - 1e-12))), bins - 1)
        before = total[b - 1] if b else 0.0
        inside = (mass - before) / max(counts[b], 1e-300)
        lower = max(low + (b - 1) * step if b else -np.inf, lowest)
        upper = min(low + b * step if b < bins - 1 else np.inf, highest)
        wide = max(upper - lower, 0.0)
        atom = (sums_[:b].sum(axis=0) + inside * sums_[b]) / mass
        point = np.array(held["w"][j * size : (j + 1) * size])
        norm = float(point @ point)
        if not len(atoms):
            new, left = atom, np.inf
            atoms, shares = atom[None, :], np.ones(1)
        else:
            # the best mean may lie lower than the bin's mean by its width at most
            left = (norm - float(point @ atom) + (mass - before) / mass * wide) / max(norm, FLOOR * radius**2, 1e-300)
            new = point
            if left > gap and norm > float(point @ atom):
                atoms, shares = np.vstack([atoms, atom]), np.append(shares, 0.0)
                shares = smallest_norm(atoms, shares)
                atoms, shares = atoms[shares > 0], shares[shares > 0]
                new = shares @ atoms
        about = float(np.linalg.norm(new - point)) * radius + max(wide, 1e-12 * max(abs(lower), abs(upper), 1e-300))
        centre = lower + inside * wide
        held["w"][j * size : (j + 1) * size] = new.tolist()
        held["low"][j], held["step"][j], held["gap"][j] = centre - about, 2 * about / BINS, float(left)
        held["atoms"][j], held["shares"][j] = atoms, shares


def _solve_small(nus: list[float], kernel: str, gap: float, passes: int):
    """Function for the blocks of one dataset beside its base: all its passes in one call."""

    def solve(blocks: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or base.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in _STATE_SCHEMA.split(", ")])
        row = base.iloc[0]
        fixed, held, worst = _fixed(row), _started(int(row["size"]), len(nus)), []
        x = np.concatenate([np.frombuffer(b).reshape(n, -1) for b, n in zip(blocks["x"], blocks["n"])])
        values = list(_values(x, fixed["marks"], kernel))
        while len(worst) < passes and (side := _open(held, fixed, gap)) is not None:
            found = _tallied("", _tally(None, values, side), side)
            _advance(held, {j: np.frombuffer(s) for _, j, s in found}, nus, fixed, blocks["radius"].max(), gap)
            worst.append(max(held["gap"]))
        return pd.DataFrame({"dataset_id": [row["dataset_id"]], "w": [held["w"]], "gap": [held["gap"]], "worst": [worst]})

    return solve


def _solve_large(packed: DataFrame, base: list, radius: dict, nus: list[float], kernel: str, gap: float, passes: int) -> list[tuple]:
    """Rows of ``_STATE_SCHEMA`` of a few datasets, whose states the driver keeps: a job per pass."""
    fixed = {row["dataset_id"]: _fixed(row) for row in base}
    held = {row["dataset_id"]: _started(row["size"], len(nus)) for row in base}
    worst: dict[str, list] = {dataset: [] for dataset in held}
    tasks = packed.rdd.getNumPartitions()
    for _ in range(passes):
        sides = {d: side for d in held if (side := _open(held[d], fixed[d], gap)) is not None}
        if not sides:
            break
        found: dict = {}
        tallies = _scan(packed, sides, kernel)
        numbers = sum(side["columns"].size for side in sides.values()) * (BINS + 2)
        if tasks * numbers > DRIVER_NUMBERS:
            tallies = spread(tallies, "dataset_id", "j").groupBy("dataset_id", "j").applyInPandas(_added, _TALLY_SCHEMA)
        for dataset, j, s in zip(*(c.to_pylist() for c in tallies.toArrow().columns)):
            known = found.setdefault(dataset, {}).get(j)
            found[dataset][j] = np.frombuffer(s) if known is None else _sum(known, np.frombuffer(s))
        for dataset, tallies in found.items():
            _advance(held[dataset], tallies, nus, fixed[dataset], radius[dataset], gap)
            worst[dataset].append(max(held[dataset]["gap"]))
    return [(d, state["w"], state["gap"], worst[d]) for d, state in held.items()]


def ocsvm_fit_all(
    sample_df: DataFrame,
    nus: list[float],
    kernel: str = "rbf",
    gap: float = GAP,
    passes: int = PASSES,
    seed: int = 0,
    landmarks: int | None = None,
    log: list | None = None,
) -> DataFrame:
    """One row per dataset: feature map and, for every nu, weights, offset and the gap reached.

    All nu share every scan. ``gap`` is relative to the squared norm of the solution; a dataset's passes end
    when all its nu are within it, or after ``passes``, and a nu within it takes no further part; ``log``
    receives the worst gap of each pass. Datasets that one task can hold make all passes there. Of larger
    ones as many go together as the driver can hold states of.
    """
    spark = sample_df.sparkSession
    rows = sample_df.select("dataset_id", "row_id", "features")
    base = durable(_start(sample_df, kernel, seed, landmarks))
    packed = _packed(rows, base, kernel)
    m = len(nus)
    numbers = F.when((F.col("size") <= NARROW) | (F.size("map") == 0), F.col("size")).otherwise(F.size("landmarks") / F.col("width"))
    sizes = packed.groupBy("dataset_id").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    sizes = durable(base.select("dataset_id", "size", numbers.alias("numbers")).join(sizes, "dataset_id"))
    held = sizes.where(F.col("n") * F.col("numbers") <= LOCAL_NUMBERS).select("dataset_id")
    state = durable(
        spread(packed.join(held, "dataset_id", "left_semi"), "dataset_id").groupBy("dataset_id")
        .cogroup(spread(base.join(held, "dataset_id", "left_semi"), "dataset_id").groupBy("dataset_id"))
        .applyInPandas(_solve_small(nus, kernel, gap, passes), _STATE_SCHEMA)
    )
    large = sizes.where(F.col("n") * F.col("numbers") > LOCAL_NUMBERS).orderBy("dataset_id").collect()
    while large:
        now, taken = [], 0
        while large and (not now or taken + (_ATOMS * m + large[0]["numbers"]) * large[0]["size"] <= DRIVER_NUMBERS):
            taken += (_ATOMS * m + large[0]["numbers"]) * large[0]["size"]
            now.append(large.pop(0))
        radius = {row["dataset_id"]: row["radius"] for row in now}
        group = F.col("dataset_id").isin(list(radius))
        solved = _solve_large(packed.where(group), base.where(group).collect(), radius, nus, kernel, gap, passes)
        state = state.unionByName(durable(spark.createDataFrame(solved, _STATE_SCHEMA)))
    if log is not None:
        steps = state.select(F.posexplode("worst").alias("at", "worst")).groupBy("at").agg(F.max("worst").alias("worst"))
        log.extend(row["worst"] for row in steps.orderBy("at").collect())
    model = durable(base.join(state.select("dataset_id", "w", "gap"), "dataset_id").select(
        "dataset_id", "width", "landmarks", "map", F.lit([float(v) for v in nus]).alias("nus"), "w",
        F.array_repeat(F.lit(0.0), m).alias("rho"), "gap",
    ))
    # the offset is the score of the ceil(nu n)-th lowest row, exact at any size
    scores = _projections(rows, model, kernel).withColumn("_one", F.lit(1))
    ranked = running_sums(scores, ["dataset_id", "nu"], "score", {"_rank": "_one"}, descending=True)
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    # scores are offset minus projection, so the largest belong to the lowest projections
    wanted = F.greatest(F.ceil(F.col("nu") * F.col("_n") - 1e-9), F.lit(1))
    rho = (
        ranked.join(sized(counts), "dataset_id").where(F.col("_rank") == wanted)
        .groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("nu", (-F.col("score")).alias("v")))).alias("_r"))
    )
    order = F.transform("nus", lambda v: F.element_at(F.filter("_r", lambda x: x["nu"] == v), 1)["v"])
    return durable(
        model.join(rho, "dataset_id").select("dataset_id", "width", "landmarks", "map", "nus", "w", order.alias("rho"), "gap")
    )


def ocsvm_fit(sample_df: DataFrame, nu: float = 0.5, kernel: str = "rbf", **options) -> DataFrame:
    """``ocsvm_fit_all`` for one nu."""
    return ocsvm_fit_all(sample_df, [nu], kernel, **options)


def _projections(rows: DataFrame, model: DataFrame, kernel: str) -> DataFrame:
    def project(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        x = matrix(part["features"])
        nus, rho = (np.asarray(side[c].iloc[0], dtype=float) for c in ("nus", "rho"))
        w, marks = np.asarray(side["w"].iloc[0], dtype=float).reshape(len(nus), -1), None
        if kernel != "linear":
            marks = np.asarray(side["landmarks"].iloc[0], dtype=float).reshape(-1, x.shape[1])
            to = np.asarray(side["map"].iloc[0], dtype=float).reshape(len(marks), -1)
        if marks is not None and w.shape[1] <= NARROW:  # in the order in which the passes saw the rows
            found = [(values @ to) @ w.T for values in _values(x, marks, kernel)]
        else:
            columns = w.T if marks is None else to @ w.T
            found = [values @ columns for values in _values(x, marks, kernel)]
        return pd.DataFrame(
            {
                "dataset_id": part["dataset_id"].iloc[0],
                "row_id": np.repeat(part["row_id"].to_numpy(), len(nus)),
                "nu": np.tile(nus, len(part)),
                "score": (rho - np.concatenate(found)).ravel(),
            }
        )

    return with_parameters(rows, model, project, "dataset_id string, row_id bigint, nu double, score double")


def ocsvm_scores_all(sample_df: DataFrame, model: DataFrame, kernel: str = "rbf") -> DataFrame:
    """(dataset_id, row_id, nu, score = rho - w . phi(x)), higher = more anomalous."""
    return _projections(sample_df.select("dataset_id", "row_id", "features"), model, kernel)


def ocsvm_scores(sample_df: DataFrame, model: DataFrame, kernel: str = "rbf") -> DataFrame:
    """(dataset_id, row_id, score) of a model with one nu."""
    return ocsvm_scores_all(sample_df, model, kernel).drop("nu")
