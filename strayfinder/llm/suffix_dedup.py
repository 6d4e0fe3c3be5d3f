"""Removal of byte strings that occur twice, by a distributed sparse suffix array.

A byte goes when a string of ``LENGTH`` bytes that also starts elsewhere, in any text, covers it. Sorting
every suffix would move the corpus many times over, so only suffixes at anchors are sorted: of the
``GRAM``-byte strings in each window of LENGTH bytes the one with the smallest hash is the window's
anchor. Equal windows have their anchor at the same place, so nothing is lost: a window is the text to
the left and to the right of its anchor.

1. ``asked``: grams and contexts (all windows of an anchor) meet by hash, packed per slice of rows (``packed``). An
   anchor whose gram occurs nowhere else is done; one whose whole context recurs is covered.
2. The rest are sorted by the suffix that begins at the anchor: each slice makes sorted runs, sends them
   front-coded (length of the common prefix with the one before, then the rest), and each task merges
   its runs with a loser tree. A run's stored prefix lengths and those found on the way tell most
   comparisons without a look at the text; no known prefix is compared again. The merged order gives
   the common lengths to the right. Sorted the other way, the left sides give theirs, and an anchor
   covers from left to right where both sum to LENGTH or more.
3. Grams with more than ``HOT`` contexts, such as the edge of a passage that a third of all texts holds,
   don't fit a task. Their windows are counted one by one by hash, which Spark combines before the shuffle.

Defined results: null and empty texts have 0 bytes and nothing removed; equal texts of LENGTH bytes or
more go whole, every copy; matches may overlap themselves; texts shorter than LENGTH stay; repeated ids
keep a row each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strayfinder.llm import packed as pk, text as tx
from strayfinder.llm.graph import groups
from strayfinder.session import durable

LENGTH = 200
GRAM = 32
SLICE_BYTES = 1 << 21
PART_BYTES = 1 << 25
BROADCAST_BYTES = 48 << 20
HOT = 20_000
FULL, OTHER, CROWDED = 1, 2, 4
PIECE = 1 << 19


def gram_size(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def _anchor_places(data: np.ndarray, length: int) -> np.ndarray:
    """For every window start the place of its anchor; windows may cross rows."""
    grams = gram_size(length)
    width = length - grams + 1
    count = max(len(data) - length + 1, 0)
    out = np.empty(count, dtype=np.int64)
    for low in range(0, count, PIECE):
        high = min(count, low + PIECE)
        part = data[low : high + length - 1]
        up, down = tx.multipliers(len(part) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        hashes = (total[grams:] - total[:-grams]) * down[: len(part) - grams + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        # the place in the low half breaks ties to the left
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = high - low
        least = np.minimum(least[:n], least[width - size : width - size + n])
        out[low:high] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
    return out


class Anchors:
    """Anchors of a slice: row, place, first and last window start, all as places in the flat bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        place = _anchor_places(data, length)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
        inside = np.flatnonzero(ends - np.arange(len(place)) >= length)
        place = place[inside]
        row = np.searchsorted(offsets, inside, "right") - 1
        first = np.ones(len(place), dtype=bool)
        first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(place))[: len(begin)] - 1
        self.data, self.offsets, self.length = data, offsets, length
        self.place, self.row = place[begin], row[begin]
        self.low, self.high = inside[begin], inside[last] if len(begin) else inside[:0]
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))

    def __len__(self) -> int:
        return len(self.place)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the gram at each anchor, and of its whole context with the anchor's place in it."""
        gram = tx.span_hashes(self.data, self.place, self.place + gram_size(self.length))
        context = tx.span_hashes(self.data, self.low, self.high + self.length)
        return gram, tx.mix(context + (self.place - self.low).astype(np.uint64))


_ASKED = pa.schema([
    ("part", pa.int64()), ("slice", pa.int64()), ("slices", pa.binary()), ("first", pa.binary()), ("second", pa.binary()),
    ("bounds", pa.binary()), ("codes", pa.binary()), ("who", pa.binary()), ("gram", pa.binary()), ("context", pa.binary()),
])
ASKED = "part long, slice long, slices binary, first binary, second binary, bounds binary, codes binary, who binary, gram binary, context binary"
SEVERAL = np.uint32(1 << 31)


def _runs_of(values: np.ndarray) -> np.ndarray:
    """True where a sorted value differs from the one before."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _ask(length: int, bits: int, coarse: int = pk.COARSE):
    """Per slice: its rows with what the slice alone tells, and one packed row per (coarse) part of the grams."""
    first_bits = pk.first_bits(bits, coarse)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                anchors = Anchors(*tx.flatten(rows.column("text")), length)
                gram, context = anchors.hashes()
                order = np.lexsort((context, gram))
                gram, context = gram[order], context[order]
                new_gram = _runs_of(gram)
                new_pair = new_gram | _runs_of(context)
                pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_gram) - 1
                copies = np.bincount(pair) if len(pair) else pair
                contexts = np.bincount(group[new_pair]) if len(pair) else pair
                codes = np.zeros(len(order), dtype=np.uint8)
                codes[order] = np.where(copies[pair] > 1, FULL, 0) | np.where(contexts[group] > 1, OTHER, 0)
                # one record a gram: its only context, or how many there are
                lead = np.flatnonzero(new_gram)
                who = order[lead].astype(np.uint32)
                several = contexts > 1
                told = np.where(several, contexts.astype(np.uint64), context[lead])
                who = np.where(several, who | SEVERAL, who).astype(np.uint32)
                asks = gram[lead]
                part = pk.place(asks, first_bits)
                leader = np.empty(len(order), dtype=np.uint32)
                leader[order] = order[lead][group].astype(np.uint32)
                out = [{
                    "part": -1 - number % 4096, "slice": number,
                    "first": rows.column("k1").to_numpy().tobytes(), "second": rows.column("k2").to_numpy().tobytes(),
                    "bounds": anchors.bounds.astype(np.int64).tobytes(), "codes": codes.tobytes(), "who": leader.tobytes(),
                }]
                for a, b in pk.cuts(part):
                    out.append({
                        "part": int(part[a]), "slice": number, "who": who[a:b].tobytes(),
                        "gram": asks[a:b].tobytes(), "context": told[a:b].tobytes(),
                    })
                yield pa.RecordBatch.from_pylist(out, _ASKED)
                number += 1

    return ask


def _deal(bits: int):
    """Grams of a coarse part, to their fine parts."""

    def deal(items: dict[str, np.ndarray]) -> list[dict]:
        order = np.argsort(items["gram"], kind="stable")
        slices, who, gram, context = (items[c][order] for c in ("slices", "who", "gram", "context"))
        part = pk.place(gram, bits)
        return [
            {
                "part": int(part[a]), "slices": slices[a:b].tobytes(), "who": who[a:b].tobytes(),
                "gram": gram[a:b].tobytes(), "context": context[a:b].tobytes(),
            }
            for a, b in pk.cuts(part)
        ]

    return deal


def _return(items: dict[str, np.ndarray]) -> list[dict]:
    """Answers that met by coarse home, sent to their slices."""
    order = np.argsort(items["slices"], kind="stable")
    slices, who, codes = (items[c][order] for c in ("slices", "who", "codes"))
    return [
        {"part": -1, "slice": int(slices[a]), "who": who[a:b].tobytes(), "codes": codes[a:b].tobytes()}
        for a, b in pk.cuts(slices)
    ]


def _answer(hot: int, homes: int | None):
    """Per part: which records share their gram, or their context, with a record of another slice.

    Answers are addressed to the slice, or with ``homes`` bits to its coarse home.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            if table["part"][0].as_py() < 0:
                yield from table.to_batches()
                continue
            pieces = [np.frombuffer(b, np.uint64) for b in table["gram"].to_pylist()]
            slices, where = pk.owners(table, [len(p) for p in pieces])
            who, context = pk.column(table, "who", np.uint32), pk.column(table, "context", np.uint64)
            gram = np.concatenate(pieces)
            several = who >= SEVERAL
            order = np.lexsort((context, several, gram))
            gram, context, several, where, who = gram[order], context[order], several[order], where[order], who[order] & ~SEVERAL
            new_gram = _runs_of(gram)
            group = np.cumsum(new_gram) - 1
            pair_new = new_gram | _runs_of(context) | several
            pair = np.cumsum(pair_new) - 1
            copies = np.bincount(pair)
            # contexts known: different ones, and the counts of slices that had several
            known = np.bincount(group, weights=np.where(several, context, pair_new).astype(float))
            lone = np.bincount(group) == 1
            code = np.where((copies[pair] > 1) & ~several, FULL, 0)
            code |= np.where(~lone[group] & ((known[group] > 1)), OTHER, 0)
            code |= np.where(known[group] > hot, CROWDED, 0)
            sent = np.flatnonzero(code)
            if not len(sent):
                continue
            owner = slices[where]
            target = owner if homes is None else pk.home(owner, homes)
            by = sent[np.argsort(target[sent], kind="stable")]
            yield pa.RecordBatch.from_pylist([
                {
                    "part": -1, "slice": int(target[by[a]]), "slices": None if homes is None else owner[by[a:b]].tobytes(),
                    "who": who[by[a:b]].astype(np.uint32).tobytes(), "codes": code[by[a:b]].astype(np.uint8).tobytes(),
                }
                for a, b in pk.cuts(target[by])
            ], _ASKED)

    return answer


TOLD = "k1 long, k2 long, n_rows long, codes binary"


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, rows, codes): a code per anchor of every text that has one."""
    for table in groups(batches, ["slice"]):
        told = {c: table[c].to_pylist() for c in ("first", "second", "bounds", "codes", "who")}
        at = next(k for k, b in enumerate(told["bounds"]) if b is not None)
        first, second, bounds = (np.frombuffer(told[c][at], np.int64) for c in ("first", "second", "bounds"))
        codes, leader = np.frombuffer(told["codes"][at], np.uint8), np.frombuffer(told["who"][at], np.uint32)
        said = np.zeros(len(codes), dtype=np.uint8)
        for k, who in enumerate(told["who"]):
            if k != at and who is not None:
                said[np.frombuffer(who, np.uint32)] |= np.frombuffer(told["codes"][k], np.uint8)
        codes = codes | said[leader] if len(codes) else codes
        out: dict[tuple[int, int], dict] = {}
        for row in np.flatnonzero(np.diff(bounds)):
            own = codes[bounds[row] : bounds[row + 1]]
            if own.any():
                key = int(first[row]), int(second[row])
                held = out.setdefault(key, {"k1": key[0], "k2": key[1], "n_rows": 0, "codes": own.tobytes()})
                held["n_rows"] += 1
        if out:
            yield pa.RecordBatch.from_pylist(
                list(out.values()),
                pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_rows", pa.int64()), ("codes", pa.binary())]),
            )


def asked(rows: DataFrame, length: int, hot: int, coarse: int = pk.COARSE) -> DataFrame:
    """(k1, k2, copies, codes) of the texts with an anchor whose gram occurs elsewhere.

    Beyond ``2 ** coarse`` parts grams and answers travel in two steps each.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // PART_BYTES).bit_length())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = bits > coarse
    sent = rows.mapInArrow(_ask(length, bits, coarse), ASKED)
    if far:
        kinds = {"who": np.uint32, "gram": np.uint64, "context": np.uint64}
        sent = pk.regather(sent, "part", "gram", kinds, _deal(bits), _ASKED, ASKED, size // 4, coarse)
    answered = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answer(hot, coarse if far else None), ASKED)
    if far:
        kinds = {"who": np.uint32, "codes": np.uint8}
        answered = pk.regather(answered, "slice", "slices", kinds, _return, _ASKED, ASKED, size // 8, coarse)
    told = answered.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_tell, TOLD)
    return told.groupBy("k1", "k2").agg(F.sum("n_rows").alias("copies"), F.first("codes").alias("codes"))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differs.bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common prefix lengths, lengths of the rests, and the rests of a sorted run."""
    shared, rests, last = [], [], b""
    for s in suffixes:
        shared.append(common(last, s, 0))
        rests.append(s[shared[-1] :])
        last = s
    return (
        np.array(shared, np.uint16).tobytes(), np.array([len(r) for r in rests], np.uint16).tobytes(), b"".join(rests),
    )


def front_decode(shared: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix in common with the one before, suffix) of a run, one at a time."""
    at, last = 0, b""
    for n, size in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist()):
        last = last[:n] + rests[at : at + size]
        at += size
        yield n, last


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, suffix, item).

    Every head carries its common prefix with the last suffix put out. Of two heads the one with the
    longer prefix is the smaller; only equal prefixes are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.known = [0] * self.size
        self.head: list[bytes | None] = [None] * self.size
        self.item: list[object] = [None] * self.size
        self.losers = [0] * self.size
        for k in range(len(runs)):
            self._advance(k)
            self.known[k] = 0
        self.best = self._build(1)

    def _advance(self, k: int) -> None:
        entry = next(self.runs[k], None) if k < len(self.runs) else None
        if entry is None:
            self.head[k] = None
        else:
            self.known[k], self.head[k], self.item[k] = entry

    def _beats(self, a: int, b: int) -> bool:
        """Whether head a is the smaller; the loser then knows its prefix with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        if self.known[a] != self.known[b]:
            return self.known[a] > self.known[b]
        n = common(x, y, self.known[a])
        first = n == len(x) if n == len(x) or n == len(y) else x[n] < y[n]
        self.known[b if first else a] = n
        return first

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, loser = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.head[self.best] is not None:
            k = self.best
            yield self.known[k], self.head[k], self.item[k]
            self._advance(k)
            node = (k + self.size) // 2
            while node:
                other = self.losers[node]
                if self._beats(other, k):
                    self.losers[node], k = k, other
                node //= 2
            self.best = k


RUN = "part long, shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, owners binary"
_RUN = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("shared", "sizes", "rests", "left_sizes", "lefts", "owners"))])


def _send(length: int, bits: int):
    """Sorted runs of the anchors whose gram has other contexts, front-coded, one per part and slice."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                data, offsets = tx.flatten(rows.column("text"))
                anchors = Anchors(data, offsets, length)
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8)
                copied = np.repeat(rows.column("copies").to_numpy() > 1, np.diff(anchors.bounds))
                at = np.flatnonzero((codes & OTHER != 0) & (codes & CROWDED == 0))
                if not len(at):
                    continue
                gram, context = anchors.hashes()
                owned = (codes & FULL == 0) & ~copied
                # of covered anchors one of each context is enough; they are only partners, also of
                # an anchor with their own context, whose cover nobody has told yet
                partner = at[~owned[at]]
                _, once = np.unique(np.column_stack([gram[partner], context[partner]]), axis=0, return_index=True)
                at = np.sort(np.concatenate([at[owned[at]], partner[once]]))
                part = (gram[at] >> np.uint64(64 - bits)).astype(np.int64)
                whole = data.tobytes()
                k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
                held: dict[int, list] = {}
                for k, p in zip(at.tolist(), part.tolist()):
                    place, row = int(anchors.place[k]), int(anchors.row[k])
                    held.setdefault(p, []).append((
                        whole[place : int(anchors.high[k]) + length],
                        whole[int(anchors.low[k]) : place][::-1],
                        (int(k1[row]), int(k2[row]), place - int(offsets[row]) if owned[k] else -1),
                    ))
                out = []
                for p, found in held.items():
                    found.sort(key=lambda f: f[0])
                    shared, sizes, rests = front_code([f[0] for f in found])
                    out.append({
                        "part": p, "shared": shared, "sizes": sizes, "rests": rests,
                        "left_sizes": np.array([len(f[1]) for f in found], np.uint16).tobytes(),
                        "lefts": b"".join(f[1] for f in found),
                        "owners": np.array([f[2] for f in found], np.int64).tobytes(),
                    })
                yield pa.RecordBatch.from_pylist(out, _RUN)

    return send


def _decoded(run: dict) -> Iterator[tuple[int, bytes, object]]:
    ends = np.cumsum(np.frombuffer(run["left_sizes"], np.uint16).astype(np.int64)).tolist()
    owners = np.frombuffer(run["owners"], np.int64).reshape(-1, 3).tolist()
    begin = 0
    for (shared, suffix), end, owner in zip(front_decode(run["shared"], run["sizes"], run["rests"]), ends, owners):
        yield shared, suffix, (run["lefts"][begin:end], owner)
        begin = end


def covered(right: list[int], lefts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For suffixes in order, the (left, right) reaches that sum to ``length`` with some other one.

    ``right[k]`` is the common length to the right of suffixes k-1 and k. The left sides are sorted
    once; among the suffixes that agree on v bytes to the right, the longest agreement to the left is
    with a neighbour in that order.
    """
    m = len(lefts)
    reach: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    by_left = sorted(range(m), key=lefts.__getitem__)
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    left = np.array([0] + [common(lefts[a], lefts[b], 0) for a, b in zip(by_left, by_left[1:])], np.int64)
    right = np.array(right, np.int64)
    longest = int(left.max(initial=0))
    best = np.full(m, -1)
    for v in sorted({int(x) for x in right[1:] if x + longest >= length}, reverse=True):
        edges = np.flatnonzero(np.concatenate(([True], right[1:] < v, [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            order = np.sort(rank[a:b])
            between = _range_minima(left, order)
            most = np.maximum(np.concatenate(([-1], between)), np.concatenate((between, [-1])))
            for k, n in zip((by_left[r] for r in order.tolist()), most.tolist()):
                if n + v >= length and n > best[k]:
                    best[k] = n
                    reach[k].append((n, v))
    return reach


def _range_minima(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Minima of ``values`` over (cuts[k], cuts[k + 1]]."""
    return np.minimum.reduceat(values[: cuts[-1] + 1], cuts[:-1] + 1)


def _merge(length: int):
    """(k1, k2, begin, end): bytes that an anchor's windows with a partner cover."""
    grams = gram_size(length)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            out: list[tuple[int, int, int, int]] = []
            right: list[int] = []
            held: list[tuple[bytes, list]] = []

            def close() -> None:
                if len(held) < 2:
                    return
                for (_, (k1, k2, place)), reaches in zip(held, covered(right, [h[0] for h in held], length)):
                    if place >= 0:
                        out.extend((k1, k2, place - n, place + v) for n, v in reaches)

            for shared, _, item in LoserTree([_decoded(run) for run in table.to_pylist()]):
                if shared < grams:
                    close()
                    right, held = [], []
                right.append(shared)
                held.append(item)
            close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["k1", "k2", "begin", "end"])

    return merge


def _windows(length: int):
    """(h1, h2, k1, k2, begin): hashes of all windows at crowded anchors."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                data, offsets = tx.flatten(rows.column("text"))
                anchors = Anchors(data, offsets, length)
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8)
                at = np.flatnonzero(codes & CROWDED)
                if not len(at):
                    continue
                counts = anchors.high[at] - anchors.low[at] + 1
                begin = np.repeat(anchors.low[at] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
                row = np.repeat(anchors.row[at], counts)
                half = length // 2
                ends = begin + length
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tx.span_hashes(data, begin, ends).view(np.int64)),
                        pa.array(tx.mix(tx.span_hashes(data, begin, begin + half) + tx.span_hashes(data, begin + half, ends) * np.uint64(3)).view(np.int64)),
                        pa.array(rows.column("k1").to_numpy()[row]), pa.array(rows.column("k2").to_numpy()[row]),
                        pa.array(begin - offsets[row]),
                    ],
                    names=["h1", "h2", "k1", "k2", "begin"],
                )

    return windows


def _small(rows: DataFrame, size, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured bytes of a written table are few; else the join shuffles."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= limit else rows


def _finish(length: int):
    """The result row of every text, from its codes and intervals."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                data, offsets = tx.flatten(rows.column("text"))
                removed = np.zeros(len(data) + 1, np.int32)
                copies = rows.column("copies").fill_null(0).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(copies > 1):
                    if offsets[k + 1] - offsets[k] >= length:
                        removed[offsets[k]] += 1
                        removed[offsets[k + 1]] -= 1
                coded = np.flatnonzero(rows.column("codes").is_valid().to_numpy(zero_copy_only=False))
                for k in coded:
                    code = np.frombuffer(rows.column("codes")[int(k)].as_py(), np.uint8)
                    if copies[k] > 1 or not (code & FULL).any():
                        continue
                    own = Anchors(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), length)
                    full = np.flatnonzero(code & FULL)
                    np.add.at(removed, offsets[k] + own.low[full], 1)
                    np.add.at(removed, offsets[k] + own.high[full] + length, -1)
                spans = rows.column("spans")
                for k in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                    for s in spans[int(k)].as_py():
                        removed[offsets[k] + s["begin"]] += 1
                        removed[offsets[k] + s["end"]] -= 1
                gone = np.cumsum(removed[:-1]) > 0
                starts, _ = tx.runs(gone, offsets)
                whole = data.tobytes()
                hashes = []
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    kept = data[a:b][~gone[a:b]].tobytes() if gone[a:b].any() else whole[a:b]
                    hashes.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), pa.array(np.diff(offsets)), pa.array(tx.row_sums(gone, offsets)),
                        pa.array(np.diff(tx.per_row(starts, offsets))), pa.array(hashes, pa.string()),
                    ],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return finish


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    body = F.coalesce(docs[text_col], F.lit(""))
    # two hashes name a text; the second doesn't depend on the first
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), body.alias("text"),
        F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("second"), body).alias("k2"),
    )
    codes = durable(asked(rows.select("text", "k1", "k2"), length, hot))
    held = _small(codes, F.octet_length("codes") + 40)
    size = codes.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    bits = max(4, int(size // 100_000).bit_length())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = rows.select("text", "k1", "k2").join(held, ["k1", "k2"])
    merged = (
        coded.mapInArrow(_send(length, bits), RUN)
        .repartition(parts, "part").sortWithinPartitions("part")
        .mapInArrow(_merge(length), "k1 long, k2 long, begin long, end long")
    )
    windows = durable(coded.mapInArrow(_windows(length), "h1 long, h2 long, k1 long, k2 long, begin long"))
    if not windows.isEmpty():
        twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        merged = merged.unionByName(
            windows.join(twice, ["h1", "h2"]).select("k1", "k2", "begin", (F.col("begin") + length).alias("end"))
        )
    spans = merged.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    told = durable(codes.join(spans, ["k1", "k2"], "left"))
    told = _small(told, F.octet_length("codes") + 16 * F.greatest(F.size("spans"), F.lit(0)) + 40)
    return (
        rows.join(told, ["k1", "k2"], "left").select("id", "text", "copies", "codes", "spans")
        .mapInArrow(_finish(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        .withColumnRenamed("id", id_col)
    )
