"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, lower-cased. Hashes of ``seed`` consecutive words
find the items whose seeds a document holds. Running Karp-Rabin, with rolling hashes of any length, then
finds the longest match that covers no marked word and marks it, again and again until none of ``seed``
words is left. A document is contaminated by an item when the marked words cover at least ``coverage``
of the item, in whatever order the passages come. Matches are never listed as pairs of places, so a
document and an item that repeat one line take memory in proportion to their words.

The items are a stated query set: they go to the tasks in blocks of at most ``ITEM_WORDS`` words, one
pass over the documents each, so no join shuffles documents and no block grows with the data. A suite of
many blocks costs as many passes.

Defined results: null and empty texts share nothing; an item of fewer words than ``seed`` matches where
all its words stand; items without words never match; equal rows get equal rows; repeated item ids are
separate items; empty tables give no rows; other columns are not read, and ``clean`` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strayfinder.llm import text as tx

SEED = 5
COVERAGE = 0.5
ITEM_WORDS = 500_000
FILTER_BITS = 22

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[97:123] = _TOKEN[128:] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and the n+1 bounds between rows."""
    data, offsets = tx.flatten(column)
    data = tx.lower_ascii(data)
    starts, ends = tx.runs(_TOKEN[data], offsets)
    return tx.span_hashes(data, starts, ends), tx.per_row(starts, offsets)


class _Rolling:
    """Karp-Rabin hashes of windows of any length over one sequence, and what of it is still unmarked."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.up, self.down = tx.multipliers(len(words) + 1)
        terms = words * self.up[: len(words)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.marked = np.zeros(len(words), dtype=bool)
        self.free = np.arange(len(words), 0, -1)

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.down[starts]

    def mark(self, spans: list[tuple[int, int]]) -> None:
        for a, b in spans:
            self.marked[a:b] = True
        # unmarked words from each place on: the distance to the next marked one
        n = len(self.words)
        ahead = np.where(self.marked, np.arange(n), n)
        self.free = np.minimum.accumulate(ahead[::-1])[::-1] - np.arange(n)


def tiling(doc: np.ndarray, item: np.ndarray, width: int, at: np.ndarray) -> tuple[int, int]:
    """Marked words and tiles of greedy string tiling; ``at`` are the places of ``doc`` to look at.

    The longest match between unmarked words is marked first; equal lengths go by the place in the item,
    then in the document. Its length comes from a binary search: windows of a length that agree exist
    for every smaller one. At that length only equal hashes are walked, each place once, so no pair
    of places is ever listed and work grows with the words times the number of different lengths.
    """
    d, i = _Rolling(doc), _Rolling(item)
    every = np.arange(len(item))
    longest = min(len(doc), len(item))
    tiles = 0

    def agreeing(at: np.ndarray, length: int) -> np.ndarray:
        known = np.unique(i.hashes(every[i.free >= length], length))
        at = at[d.free[at] >= length]
        if not len(known) or not len(at):
            return at[:0]
        own = d.hashes(at, length)
        return at[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]

    while longest >= width:
        at = agreeing(at, width)
        if not len(at):
            break
        low, high, held = width, min(longest, int(d.free[at].max()), int(i.free.max())), at
        while low < high:
            middle = (low + high + 1) // 2
            found = agreeing(held, middle)
            if len(found):
                low, held = middle, found
            else:
                high = middle - 1
        own = d.hashes(held, low)
        order = np.argsort(own, kind="stable")
        places, own = held[order], own[order]
        starts = every[i.free >= low]
        wanted = i.hashes(starts, low)
        begin, end = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
        blocked = np.zeros(len(doc) + 1, dtype=bool)
        first: dict[int, int] = {}
        item_spans, doc_spans, until = [], [], 0
        for s, a, b in zip(starts.tolist(), begin.tolist(), end.tolist()):
            if s < until or a == b:
                continue
            k = first.get(a, a)
            while k < b and blocked[places[k]]:
                k += 1
            first[a] = k
            if k == b:
                continue
            p = int(places[k])
            if not np.array_equal(doc[p : p + low], item[s : s + low]):
                continue  # equal hashes of different words
            item_spans.append((s, s + low))
            doc_spans.append((p, p + low))
            blocked[max(p - low + 1, 0) : p + low] = True
            until = s + low
        if not item_spans:
            longest = low - 1
            continue
        i.mark(item_spans)
        d.mark(doc_spans)
        tiles += len(item_spans)
        longest = low
    return int(i.marked.sum()), tiles


@dataclass
class Items:
    """A block of items with the hashes of all their seeds, by seed width."""

    ids: list[int | None]
    sizes: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], seed: int) -> "Items":
        words, bounds = tokens(pa.array(texts, pa.string()))
        sizes = np.diff(bounds)
        seeds = {}
        for width in sorted({min(seed, int(n)) for n in sizes if n}):
            chosen = (sizes >= seed) if width == seed else (sizes == width)
            starts = tx.inner(bounds, width)
            rows = tx.row_of(bounds)[starts]
            starts, rows = starts[chosen[rows]], rows[chosen[rows]]
            hashes = tx.window_hashes(words, width)[starts]
            order = np.argsort(hashes, kind="stable")
            hashes, rows, starts = hashes[order], rows[order], starts[order]
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            seeds[width] = hashes, rows, starts - bounds[rows], bits
        return cls(ids, sizes, words, bounds, seeds)


def tile(column: pa.Array, items: Items, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, matched words, tiles, doc words) of the pairs that reach ``coverage``."""
    words, bounds = tokens(column)
    row_of = tx.row_of(bounds)
    for width, (hashes, item_rows, item_starts, bits) in items.seeds.items():
        starts = tx.inner(bounds, width)
        if not len(starts):
            continue
        windows = tx.window_hashes(words, width)
        starts = starts[bits[windows[starts] & np.uint64((1 << FILTER_BITS) - 1)]]
        # the distinct (seed, item) pairs, and for each row the distinct seeds that it holds
        first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (item_rows[1:] != item_rows[:-1]))))
        seeds, owners = hashes[first], item_rows[first]
        copies = np.diff(np.append(first, len(hashes)))
        own = windows[starts]
        starts = starts[seeds[np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)] == own]
        if not len(starts):
            continue
        for row in np.unique(row_of[starts]):
            at = starts[np.searchsorted(starts, bounds[row]) : np.searchsorted(starts, bounds[row + 1])]
            own = np.unique(windows[at])
            low, high = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
            count = high - low
            hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            # a tile of n words holds n - width + 1 seeds of the item, so n <= width * seeds
            reach = np.bincount(owners[hit], copies[hit], len(items.sizes))
            doc = words[bounds[row] : bounds[row + 1]]
            for item in np.flatnonzero((reach > 0) & (width * reach >= coverage * items.sizes)):
                text = items.words[items.bounds[item] : items.bounds[item + 1]]
                marked, tiles = tiling(doc, text, width, at - bounds[row])
                if marked >= coverage * len(text):
                    yield int(row), int(item), marked, tiles, len(doc)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in lists of at most ``ITEM_WORDS`` words, streamed to the driver one block at a time."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        words = len((row[1] or "").split())
        if held and size + words > ITEM_WORDS:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += words
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item it gives away: words and tiles marked, share of the item."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType),
        *(T.StructField(n, T.LongType()) for n in ("n_words", "n_item_words", "n_matched", "n_tiles")),
        T.StructField("coverage", T.DoubleType()),
    ])
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def find(batches, sent=sent):
            ids, texts = zip(*sent.value)
            items = Items.of(list(ids), list(texts), seed)
            for batch in batches:
                for part in tx.slices(batch, "text"):
                    found = list(tile(part.column("text"), items, coverage))
                    if found:
                        row, item, marked, tiles, n_words = (np.array(x) for x in zip(*found))
                        sizes = items.sizes[item]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("id").take(pa.array(row)),
                                pa.array([items.ids[k] for k in item]).cast(pa.int64()),
                                pa.array(n_words), pa.array(sizes), pa.array(marked), pa.array(tiles),
                                pa.array(marked / sizes),
                            ],
                            names=schema.names,
                        )

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    coverage: float = COVERAGE,
) -> DataFrame:
    """The rows of ``docs`` that give no item away, columns as they were; no shuffle, one pass a block."""
    names = docs.columns
    at = names.index(text_col)
    short = docs.toDF(*(f"c{k}" for k in range(len(names))))
    for block in item_blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, sent=sent):
            ids, texts = zip(*sent.value)
            items = Items.of(list(ids), list(texts), seed)
            for batch in batches:
                for part in tx.slices(batch, f"c{at}"):
                    kept = np.ones(part.num_rows, dtype=bool)
                    kept[[row for row, *_ in tile(part.column(at), items, coverage)]] = False
                    yield part.filter(pa.array(kept))

        short = short.mapInArrow(keep, short.schema)
    return short.toDF(*names)
