"""Packed records between slices of rows and parts of a key space, in one or two steps.

A task packs the items of a slice into one binary record per part, so that Spark shuffles a few
kilobytes at a time and not single items. With ever more parts a slice has ever less for each. Beyond
``2 ** COARSE`` parts items therefore go to coarse parts first; there the records of many slices are
joined up to ``HOLD_BYTES`` and dealt to the fine parts. The answers go back to their slices in the same
two steps. A coarse part needs no task of its own: its records spread over several by their hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strayfinder.llm import text as tx

COARSE = 10
HOLD_BYTES = 1 << 25
#: bytes of one coarse part that one task joins
TASK_BYTES = 1 << 28


def first_bits(bits: int, coarse: int = COARSE) -> int:
    """Bits of the parts that slices send to."""
    return min(bits, coarse)


def place(values: np.ndarray, bits: int) -> np.ndarray:
    """The part of each 64-bit value: its leading bits."""
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def cuts(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    if len(places):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1, [len(places)]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def home(slices: np.ndarray, coarse: int = COARSE) -> np.ndarray:
    """Where answers to a slice meet first, as a negative number; slices aren't negative."""
    return -1 - place(tx.mix(slices.astype(np.uint64)), coarse)


def joined(batches: Iterator[pa.RecordBatch], key: str, size: str, hold: int) -> Iterator[pa.Table]:
    """Consecutive records of one key, about ``hold`` bytes of column ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    total, last = 0, None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(batch.column(size)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for k in range(batch.num_rows):
            if (keys[k] != last or total >= hold) and (held or k > begin):
                yield pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                held, total, begin = [], 0, k
            last = keys[k]
            total += int(sizes[k])
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """All items of a binary column, end to end."""
    return np.concatenate([np.frombuffer(b, kind) for b in table[name].to_pylist()])


def owners(table: pa.Table, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The slices of the table, and each item's index in them; named per item, or once per record."""
    if table["slices"].null_count == 0:
        return np.unique(column(table, "slices", np.int64), return_inverse=True)
    slices, where = np.unique(table["slice"].to_numpy(), return_inverse=True)
    return slices, np.repeat(where, counts)


def regather(
    rows: DataFrame, key: str, size: str, kinds: dict[str, type], deal: Callable[[dict[str, np.ndarray]], list[dict]],
    schema: pa.Schema, spark_schema: str, expected: int, coarse: int = COARSE, hold: int | None = None,
) -> DataFrame:
    """Second step: joins the records of each coarse place ``key`` and deals their items anew.

    ``deal`` gets the items of all ``kinds`` columns and ``slices``, and returns records. ``size`` is a
    column that is null in records without items; those go through as they are. ``expected``
    bytes in all decide over how many tasks a coarse place spreads.
    """
    limit = HOLD_BYTES if hold is None else hold
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, expected // (TASK_BYTES << coarse))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined(batches, key, size, limit):
            plain = pc.is_null(table[size])
            if pc.any(plain).as_py():
                yield from table.filter(plain).to_batches()
                table = table.filter(pc.invert(plain))
                if not table.num_rows:
                    continue
            items = {name: column(table, name, kind) for name, kind in kinds.items()}
            first = next(iter(kinds))
            counts = [len(b) // np.dtype(kinds[first]).itemsize for b in table[first].to_pylist()]
            slices, where = owners(table, counts)
            yield pa.RecordBatch.from_pylist(deal(items | {"slices": slices[where]}), schema)

    spread = rows.repartition(parts, F.col(key), F.pmod(F.xxhash64("slice", size), F.lit(tasks)))
    return spread.sortWithinPartitions(key).mapInArrow(step, spark_schema)
