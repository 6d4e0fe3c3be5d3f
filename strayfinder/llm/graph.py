"""Helpers of the pairing operators: connected components and groups of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strayfinder.session import durable

SMALL_ROWS = 2_000_000


def small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``rows``, with a broadcast hint if they are at most ``limit`` narrow rows; else a shuffle joins them."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); lone nodes have no row.

    Every round links the larger neighbours of a node to its smallest one, then the smaller ones
    (large star, small star), until all edges point to the smallest node. Rounds are written, their
    number grows with the logarithm of a component's size; a node's neighbours are only ever reduced
    to a minimum, never gathered.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        edges = durable(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k) for k in keys]
        change = None
        for column in columns:
            differs = pc.not_equal(column[1:], column[:-1])
            change = differs if change is None else pc.or_(change, differs)
        cuts = [0, *(k + 1 for k in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[low].as_py() for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)
