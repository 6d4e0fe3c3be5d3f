"""Session settings and the helpers that decide between small-side and large-side plans."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from inspect import isgeneratorfunction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.storagelevel import StorageLevel

# Largest measured size of a parameter table that may be broadcast.
SMALL_BYTES = 128 << 20
# Largest number of rows one window partition may sort; larger groups are range-partitioned.
WINDOW_ROWS = 5_000_000
# Rows of one dataset handed to one Python call on the shuffled path.
BLOCK_ROWS = 20_000
# Feature values that a task gathers before it splits them by dataset: as many as these, or fewer once
# the datasets among them have so many rows each. A value of a gathered row takes up to 100 bytes.
GATHER_CELLS = 2_000_000
GATHER_LEAST = 100_000
GATHER_ROWS = 1_000
# Bytes of an Arrow batch whose rows are known to be narrow.
BATCH_BYTES = 64 << 20
# Numbers that a task holds as states of its datasets.
STATE_CELLS = 8_000_000


def local_session(app: str = "strayfinder", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without a setting gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="strayfinder-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so a lost executor cannot change it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` with a stated partition count.

    Adaptive execution merges partitions by bytes, which would queue small but slow Python groups
    in one task; it keeps a stated count. Later steps on the same keys need no other shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """Compute a parameter table once, keep it, and return it with its size in bytes.

    The size counts every array element, so tables of few wide rows are judged rightly.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 8 + 16
        elif isinstance(kind, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        else:
            width = width + 8
    return kept, kept.agg(F.sum(width)).first()[0] or 0


def sized(df: DataFrame) -> DataFrame:
    """Keep a parameter table; hint a broadcast only when its measured size is small.

    Above the bound the table is returned without a hint and joins as a shuffled side, where
    adaptive execution splits skewed keys.
    """
    kept, size = measured(df)
    return F.broadcast(kept) if size <= SMALL_BYTES else kept


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: a counting job with map-side partial aggregation."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    max_group: int | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """Add running totals ``{output: input}`` over ``order`` within ``keys``, exact at any size.

    Equal values of ``order`` are added one row at a time, in any order. Groups proven small use one window. Otherwise rows
    are range-partitioned on (keys, order), so a group holding most of the data is cut into many
    sorted pieces, and each piece adds the totals of the pieces before it.
    """
    keys = list(keys)
    window_rows = WINDOW_ROWS if window_rows is None else window_rows
    if max_group is None:
        max_group = largest_group(df, keys)
    sort = F.col(order).desc() if descending else F.col(order).asc()
    if max_group <= window_rows:
        w = Window.partitionBy(*keys).orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(src).over(w).alias(out) for out, src in sums.items()])
    pieces = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        4 * (-(-max_group // max(window_rows, 1))),
    )
    pieces = min(pieces, 20_000)
    ranged = durable(
        df.repartitionByRange(pieces, *[F.col(k) for k in keys], sort).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_piece")
        .agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
        .select(
            *keys,
            "_piece",
            *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        )
    )
    w = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(sort)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.select("*", *[F.sum(src).over(w).alias(f"_r_{out}") for out, src in sums.items()])
        .join(offsets, [*keys, "_piece"])
        .select(*df.columns, *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])
    )


@contextmanager
def batches_by_rows(spark: SparkSession, width: int) -> Iterator[None]:
    """Jobs run inside cut Arrow batches by their number of rows alone, where ``width`` numbers a row keep these small.

    The limit in bytes is tested for every row, by the sizes of all buffers, which takes longer than the
    row itself. Wider rows keep it.
    """
    limit, records = (f"spark.sql.execution.arrow.{n}" for n in ("maxBytesPerBatch", "maxRecordsPerBatch"))
    before, most = spark.conf.get(limit), int(spark.conf.get(records))
    if not 0 < most * (8 * width + 100) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(limit, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def gathered(
    batches: Iterator[pd.DataFrame | pa.RecordBatch], cells: int = GATHER_CELLS
) -> Iterator[pd.DataFrame | pa.Table]:
    """Batches joined up to about ``cells`` feature values, so interleaved datasets come in few pieces.

    Few datasets come in large pieces anyhow; then a task holds little more than one batch.
    """
    held: list = []
    size = rows = 0
    datasets: set = set()

    def joined():
        return pa.Table.from_batches(held) if isinstance(held[0], pa.RecordBatch) else pd.concat(held, ignore_index=True)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if isinstance(batch, pa.RecordBatch):
            size += len(batch.column("features").flatten())
            datasets.update(batch.column("dataset_id").unique().to_pylist())
        else:
            size += len(batch) * (len(batch["features"].iloc[0]) if "features" in batch else batch.shape[1])
            if "dataset_id" in batch:
                datasets.update(batch["dataset_id"].unique())
        if size >= cells or (size >= GATHER_LEAST and rows >= GATHER_ROWS * max(len(datasets), 1)):
            yield joined()
            held, size, rows, datasets = [], 0, 0, set()
    if held:
        yield joined()


def dataset_arrays(table: pa.Table) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """Per dataset its columns as arrays, ``features`` as a matrix with NaN for NULL.

    No row becomes a Python object. Rows without a dataset are left out, like in a pandas group.
    """
    ids = table["dataset_id"].combine_chunks().dictionary_encode()
    codes = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    if len(ids.dictionary) < 32_000:
        codes = codes.astype(np.int16)  # sorted by radix
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(ids.dictionary) + 1))
    lists = table["features"].combine_chunks()
    if lists.null_count:
        raise ValueError("rows without features")
    starts, widths = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    values = lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    plain = {
        c: table[c].to_numpy() for c in table.column_names if c not in ("dataset_id", "features")
    }
    for dataset, low, high in zip(ids.dictionary.to_pylist(), bounds[:-1], bounds[1:]):
        at = order[low:high]
        width = widths[at[0]]
        if (widths[at] != width).any():
            raise ValueError(f"rows of dataset {dataset} differ in width")
        out = {c: v[at] for c, v in plain.items()}
        out["features"] = values[starts[at][:, None] + np.arange(width)]
        yield dataset, out


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def arrow_batches(frames: Iterator[pd.DataFrame], schema: str) -> Iterator[pa.RecordBatch]:
    """Frames of plain columns as Arrow batches of the types in ``schema``."""
    fields = [(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(","))]
    for frame in frames:
        yield pa.RecordBatch.from_pandas(frame, pa.schema(fields), preserve_index=False)


def per_dataset(
    batches: Iterator[pa.RecordBatch],
    step: Callable,
    finish: Callable,
    side_of: Callable = lambda dataset: None,
) -> Iterator[pd.DataFrame]:
    """Fold a task's rows into one state per dataset and emit each state once.

    ``step(state or None, rows, side)`` gets rows as by ``dataset_arrays`` and returns a tuple of arrays,
    ``finish(dataset, state, side)`` its rows. States are emitted early only when all of them hold more
    than ``STATE_CELLS`` numbers; the aggregate behind adds what several tasks, or such early ends, emit.
    """
    states: dict = {}
    held = 0

    def emit() -> pd.DataFrame:
        return pd.concat([finish(d, s, side_of(d)) for d, s in states.items()], ignore_index=True)

    for batch in gathered(batches):
        for dataset, part in dataset_arrays(batch):
            known = states.get(dataset)
            states[dataset] = step(known, part, side_of(dataset))
            if known is None:
                held += sum(np.size(x) for x in states[dataset])
        if held > STATE_CELLS:
            yield emit()
            states, held = {}, 0
    if states:
        yield emit()


def fold_with_parameters(
    rows: DataFrame,
    params: DataFrame,
    step: Callable,
    finish: Callable,
    schema: str,
    size: int | None = None,
    prepare: Callable = lambda side: side,
) -> DataFrame:
    """``with_parameters`` for results that add up: a task emits once per dataset, not once per batch.

    ``step`` and ``finish`` get a dataset's parameters as ``prepare`` makes them, once per dataset.
    """

    def whole(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        side = prepare(side)
        return finish(part["dataset_id"].iloc[0], step(None, part, side), side)

    def folded(batches, side_of):
        prepared: dict = {}

        def ready(dataset):
            if dataset not in prepared:
                prepared[dataset] = prepare(side_of(dataset))
            return prepared[dataset]

        return arrow_batches(per_dataset(batches, step, finish, ready), schema)

    return with_parameters(rows, params, whole, schema, size, folded)


@dataclass
class Fold:
    """Arguments of one ``fold_with_parameters``; without ``params`` its steps get None beside the rows."""

    params: DataFrame | None
    step: Callable
    finish: Callable
    schema: str
    prepare: Callable = lambda side: side


def fold_together(rows: DataFrame, folds: Sequence[Fold]) -> list[DataFrame]:
    """The written results of several folds over the same rows, read once where all parameters are small."""
    sizes = [0 if f.params is None else measured(f.params)[1] for f in folds]
    if sum(sizes) > SMALL_BYTES:
        return [
            durable(rows.mapInArrow(_alone(f), f.schema))
            if f.params is None
            else durable(fold_with_parameters(rows, f.params, f.step, f.finish, f.schema, size, f.prepare))
            for f, size in zip(folds, sizes)
        ]
    sides = [
        None if f.params is None else {d: f.prepare(s) for d, s in f.params.toPandas().groupby("dataset_id", sort=False)}
        for f in folds
    ]
    shared = rows.sparkSession.sparkContext.broadcast(sides)
    steps = [(f.step, f.finish) for f in folds]
    kinds = dict(c.split() for f in folds for c in f.schema.split(","))
    schema = ", ".join(f"{name} {kind}" for name, kind in {**kinds, "_fold": "int"}.items())
    # integers stay exact where another fold has no such column
    whole = {name for name, kind in kinds.items() if kind in ("int", "bigint")}

    def sides_of(dataset):
        found = [None if side is None else side.get(dataset) for side in shared.value]
        if any(own is None and side is not None for own, side in zip(found, shared.value)):
            raise ValueError(f"no parameters for dataset {dataset}")
        return found

    def step(states, part, found):
        known = states[0] if states is not None else [None] * len(steps)
        new = [own(state, part, side) for (own, _), state, side in zip(steps, known, found)]
        return _States(new)

    def finish(dataset, states, found) -> pd.DataFrame:
        frames = [
            end(dataset, state, side).assign(_fold=k)
            for k, ((_, end), state, side) in enumerate(zip(steps, states[0], found))
        ]
        kept = [f.astype({c: "Int64" for c in f.columns if c in whole}) for f in frames]
        return pd.concat(kept, ignore_index=True)

    def scan(batches):
        return arrow_batches(per_dataset(batches, step, finish, sides_of), schema)

    found = durable(rows.mapInArrow(scan, schema))
    return [
        found.where(F.col("_fold") == k).select(*(c.split()[0] for c in f.schema.split(",")))
        for k, f in enumerate(folds)
    ]


class _States(tuple):
    """One entry, the states of several folds; its size is that of all of them."""

    def __new__(cls, states):
        return super().__new__(cls, (states,))

    def __iter__(self):
        return (x for state in self[0] for x in state)


def _alone(fold: Fold) -> Callable:
    def scan(batches):
        return arrow_batches(per_dataset(batches, fold.step, fold.finish), fold.schema)

    return scan


def with_parameters(
    rows: DataFrame,
    params: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    size: int | None = None,
    folded: Callable | None = None,
) -> DataFrame:
    """Apply ``fn(rows of one dataset, that dataset's parameters)`` in Arrow batches.

    Parameter tables measured as small are broadcast and ``rows`` is not shuffled. Larger ones meet
    their rows in a co-grouped shuffle on (dataset, block); a large dataset spans many blocks, so
    no task holds more than about ``BLOCK_ROWS`` of its rows. Pass ``size`` in bytes when the same
    table was measured before. Rows of a dataset without parameters raise. ``fn`` may be a generator
    of frames.
    """
    if size is None:
        params, size = measured(params)
    if size <= SMALL_BYTES:
        by_dataset = dict(iter(params.toPandas().groupby("dataset_id", sort=False)))
        shared = rows.sparkSession.sparkContext.broadcast(by_dataset)

        def side_of(dataset):
            side = shared.value.get(dataset)
            if side is None:
                raise ValueError(f"no parameters for dataset {dataset}")
            return side

        def batches(iterator):
            if folded is not None:
                yield from folded(iterator, side_of)
                return
            for batch in gathered(iterator):
                found = [fn(part, side_of(d)) for d, part in batch.groupby("dataset_id", sort=False)]
                if isgeneratorfunction(fn):
                    for frames in found:
                        yield from frames
                else:
                    yield pd.concat(found, ignore_index=True)

        return rows.mapInPandas(batches, schema) if folded is None else rows.mapInArrow(batches, schema)

    blocks = sized(
        rows.groupBy("dataset_id")
        .count()
        .select("dataset_id", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("_n"))
    )
    left = (
        rows.join(blocks, "dataset_id")
        .withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.col("_n")).cast("int"))
        .drop("_n")
    )
    right = (
        params.join(blocks, "dataset_id")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .drop("_n")
    )

    def block(part: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=columns)
        if side.empty:
            raise ValueError(f"no parameters for dataset {part['dataset_id'].iloc[0]}")
        found = fn(part.drop(columns="_block"), side.drop(columns="_block"))
        if not isgeneratorfunction(fn):
            return found
        frames = list(found)
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    columns = [c.split()[0] for c in schema.replace(", ", ",").split(",")]
    return (
        left.groupBy("dataset_id", "_block")
        .cogroup(right.groupBy("dataset_id", "_block"))
        .applyInPandas(block, schema)
    )
