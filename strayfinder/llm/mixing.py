"""Mixing sources to target weights by balanced (cube method) sampling.

Every source gets a target number of words: its share by weight of all words, at most ``most`` times
what it has, the excess going to the others by weight. Each document is then taken ``floor(r)`` or
``floor(r) + 1`` times, r being target over source size. The fractional parts are inclusion
probabilities that the cube method moves through the null space of two constraints, the number of
documents and the number of words of the source, until they are 0 or 1.

The flight runs in blocks of a source dealt by a hash of the id and, among rows of one id or without
one, round by round in order of size, so a source that holds a third of all rows is
many tasks; at most two documents of a block stay undecided, and those meet in the blocks of the next
level until one block per source is left. There a few documents of spread sizes are held back, and
the landing tries all choices of these and of the undecided two.

Defined results: a null text has size 0; documents of size 0 are taken 0 times; a null source is one
more source, last in order; equal rows are separate documents; an empty table or one without words
gives targets of 0; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strayfinder.session import durable, running_sums

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
EDGE = 1e-9
#: documents of a source that are decided together at the end, with at most two left by the flight
LANDING = 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``sizes`` (slot, source_size, weight) with ``target``; the only table is one row per source.

    A source is capped when, with all sources of a smaller size per weight capped, an even share
    still exceeds its cap; sorting by size per weight finds all of them in one pass.
    """
    cap = F.lit(most) * F.col("source_size")
    before = W.orderBy((F.col("source_size") / F.col("weight")), "slot").rowsBetween(
        W.unboundedPreceding, -1
    )
    total = F.sum("source_size").over(W.partitionBy())
    weights = F.sum("weight").over(W.partitionBy())
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    shared = sizes.withColumn("level", level).withColumn(
        "capped", cap <= F.col("level") * F.col("weight")
    )
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.partitionBy())
    return shared.withColumn("free", free).select(
        *sizes.columns,
        F.when(F.col("capped"), cap).otherwise(F.col("free") * F.col("weight")).alias("target"),
    )


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``p`` to 0 or 1 keeping its sum and its sum over ``size``; at most two stay between.

    Three open units always have a direction that changes neither sum.
    """
    p = p.tolist()
    size = size.tolist()
    chance = iter(rng.random(len(p) + 8).tolist())
    queue = iter([k for k, x in enumerate(p) if EDGE < x < 1 - EDGE])
    open_units: list[int] = []
    while True:
        open_units = [k for k in open_units if 0.0 < p[k] < 1.0]
        while len(open_units) < 3 and (k := next(queue, None)) is not None:
            open_units.append(k)
        if len(open_units) == 3:
            a, b, c = (size[k] for k in open_units)
            u = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        elif len(open_units) == 2 and size[open_units[0]] == size[open_units[1]]:
            u = [1.0, -1.0]
        else:
            return np.array(p)
        up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(open_units, u) if d)
        down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(open_units, u) if d)
        step = up if next(chance) * (up + down) < down else -down
        for k, d in zip(open_units, u):
            x = p[k] + step * d
            p[k] = 0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few open units: of all choices, that nearest to the words, then to the documents."""
    at = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(choices @ size[at] - p[at] @ size[at])
        count = np.abs(choices.sum(axis=1) - p[at].sum())
        p = p.copy()
        p[at] = choices[np.argmin(words + count * size[at].min() / 8)]
    return p


def reserve(size: np.ndarray) -> np.ndarray:
    """Units that the flights leave to the landing: ranks 0, 1, 2, 4, 8, ... by size and the smallest."""
    ranks = {0, *(1 << k for k in range(LANDING - 6)), *range(len(size) - 5, len(size))}
    return np.array(sorted(k for k in ranks if 0 <= k < len(size)), dtype=int)


def _fly(level: int, seed: int, last: bool):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "again"], ascending=[False, True, True], ignore_index=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        p, size = rows["p"].to_numpy(float).copy(), rows["size"].to_numpy(float)
        held = np.zeros(len(p), dtype=bool)
        if key[1] == 0:  # one block of each source and level
            between = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
            held[between[reserve(size[between])]] = True
        p[~held] = flight(p[~held], size[~held], rng)
        rows["p"] = land(p, size) if last else p
        return rows

    return fly


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken words."""
    if block < 4 * LANDING:
        raise ValueError(f"block must be at least {4 * LANDING}")
    sized = durable(
        docs.select(
            docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = totals.withColumn(
        "slot", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = ranked.withColumn("weight", F.element_at(cycle, (F.col("slot") % len(weights) + 1).cast("int")))
    plan = durable(
        targets(weighted.select("slot", "source_size", "weight"), most)
        .join(ranked.select("slot", "source", "n"), "slot")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )
    units = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "id", "slot", "size", F.xxhash64("id").alias("tie"), "n", F.floor("rate").alias("whole"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"),
    )
    # rows of a source with the same id are numbered, whatever their order in the table
    numbered = running_sums(units.withColumn("one", F.lit(1).cast("long")), ["slot", "tie"], "size", {"again": "one"})
    units = numbered.drop("one").withColumn("again", F.col("again") - 1)
    schema = units.schema
    largest = plan.agg(F.max("n")).first()[0] or 0
    decided = []
    level = 0
    while True:
        blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
        last = largest <= block
        part = F.pmod(F.pmod(F.xxhash64("id", F.lit(level)), blocks) + F.col("again"), blocks)
        moved = units.groupBy("slot", part.alias("part")).applyInPandas(_fly(level, seed, last), schema)
        if last:
            decided.append(moved)
            break
        moved = durable(moved)
        decided.append(moved.where((F.col("p") == 0) | (F.col("p") == 1)))
        # at most two of a block go on, and those held back for the landing
        units = moved.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn(
            "n", 2 * F.ceil(F.col("n") / block) + LANDING
        ).select(*schema.names)
        largest = 2 * -(-largest // block) + LANDING
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.join(F.broadcast(plan) if largest_sources(plan) else plan, "slot").select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"),
        F.when(F.col("size") > 0, copies * F.col("size")).otherwise(0).cast("long").alias("taken"),
    )


def largest_sources(plan: DataFrame, limit: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast; the result is the same."""
    return plan.limit(limit + 1).count() <= limit
