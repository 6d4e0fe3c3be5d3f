"""N-gram Jaccard join: exact set similarity by prefix trees, as connected classes of documents.

A document's set holds the hashes of its distinct shingles of ``WIDTH`` words (lower-cased A-Z); with
fewer words the whole sequence is one. Documents link when intersection / union >= THRESHOLD percent.

1. ``shared``: shingles meet in parts of the hash space, and each set learns how many of its shingles
   occur in another set. A set with fewer than THRESHOLD percent cannot link and goes no further.
   Shingles travel as packed arrays, once per slice of rows, so a shingle that a third of all documents
   holds is as many items as there are slices; beyond 1,024 parts in two steps (``packed``).
2. Equal sets collapse to the smallest id, and those left learn the same of each other. The prefixes, rare
   shingles first, that similar sets must share give candidate clusters (through the smallest id of a
   prefix shingle and size class, so a hot shingle is a star and never a list of pairs).
3. ``Trie``: a cluster's sets, in the global order of their hashes, are stored in a prefix tree. Each set walks the tree sharing partial
   overlaps; a subtree is left when the remaining length cannot reach the overlap needed, or when all of
   it is in the set's class already. Clusters too large for a task go in blocks, then delegates of the
   classes found meet, and what is still apart is compared exactly over shared prefix shingles.

Defined results: null, empty and wordless texts have size 0 and link with nothing; equal ids are one
document for ``component_id`` but keep a row each; a null id keeps its row and never names a class (null
if no member has an id, but such sets link and carry chains like others); texts of any length are read whole; empty tables give empty results; other columns
are not read by ``classes``, and ``distinct`` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from strayfinder.llm import packed as pk, text as tx
from strayfinder.llm.graph import components, groups, small
from strayfinder.session import durable

WIDTH = 5
THRESHOLD = 80
SLICE_BYTES = 1 << 21
PART_BYTES = 1 << 24
#: shingles of one trie; larger clusters go in blocks
TRIE_SHINGLES = 4_000_000
DELEGATES = 16
#: size classes differ by so much more than 100 / threshold, so similar sets are in the same or the next one
CLASS = 1.008
NOBODY = np.uint16(65535)
SLICE_ROWS = 65_000


def sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within a row, and the n+1 bounds of the rows."""
    data, offsets = tx.flatten(column)
    data = tx.lower_ascii(data)
    starts, ends, bounds = tx.words(data, offsets)
    hashes, rows = tx.shingle_hashes(tx.span_hashes(data, starts, ends), bounds, width)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets))).astype(np.int64)


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per row that name its set."""
    out = []
    for salt in (0x1F3D5B79, 0x2E4C6A88):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(hashes + np.uint64(salt)), dtype=np.uint64)))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _short_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tx.slices(batch, "text", SLICE_BYTES):
        for low in range(0, part.num_rows, SLICE_ROWS):
            yield part.slice(low, SLICE_ROWS)


PACKED = "part long, slice long, slices binary, ids binary, sizes binary, high binary, low binary, counts binary, who binary, shingles binary"
_PACKED = pa.schema([("part", pa.int64()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("slices", "ids", "sizes", "high", "low", "counts", "who", "shingles"))])


def _values(token: np.ndarray, bits: int) -> np.ndarray:
    """What tells shingles of one part apart: the 32 bits behind its own."""
    return ((token << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _ask(width: int, bits: int, coarse: int = pk.COARSE):
    """Per slice: one row that describes its sets, and one row of shingles per (coarse) part of the hash space."""
    first_bits = pk.first_bits(bits, coarse)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in _short_slices(batch):
                hashes, bounds = sets(rows.column("text"), width)
                sizes = np.diff(bounds)
                high, low = fingerprints(hashes, bounds)
                # equal sets of a slice ask once
                _, first = np.unique(np.column_stack([high, low, sizes]), axis=0, return_index=True)
                asks = np.zeros(len(sizes), dtype=bool)
                asks[first] = True
                owner = tx.row_of(bounds)
                token, owner = hashes[asks[owner]], owner[asks[owner]]
                order = np.argsort(token, kind="stable")
                token, owner = token[order], owner[order]
                new = np.ones(len(token), dtype=bool)
                new[1:] = token[1:] != token[:-1]
                alone = new & np.append(new[1:], True) if len(token) else new
                counts = np.bincount(owner[~alone], minlength=len(sizes))
                who = np.where(alone, owner, NOBODY).astype(np.uint16)[new]
                token = token[new]
                part = pk.place(token, first_bits)
                value = _values(token, bits) if first_bits == bits else token
                out = [{
                    "part": -1 - number % 4096, "slice": number,
                    "ids": rows.column("id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).tobytes(),
                    "sizes": sizes.astype(np.int64).tobytes(), "high": high.tobytes(), "low": low.tobytes(),
                    "counts": np.where(asks, counts, -1).astype(np.int64).tobytes(),
                }]
                for a, b in pk.cuts(part):
                    out.append({"part": int(part[a]), "slice": number, "who": who[a:b].tobytes(), "shingles": value[a:b].tobytes()})
                yield pa.RecordBatch.from_pylist(out, _PACKED)
                number += 1

    return ask


def _deal(bits: int):
    """Shingles of a coarse part, to their fine parts."""

    def deal(items: dict[str, np.ndarray]) -> list[dict]:
        order = np.argsort(items["shingles"], kind="stable")
        token, who, slices = (items[c][order] for c in ("shingles", "who", "slices"))
        part, value = pk.place(token, bits), _values(token, bits)
        return [
            {"part": int(part[a]), "slices": slices[a:b].tobytes(), "who": who[a:b].tobytes(), "shingles": value[a:b].tobytes()}
            for a, b in pk.cuts(part)
        ]

    return deal


def _return(items: dict[str, np.ndarray]) -> list[dict]:
    """Answers that met by coarse home, added up per row and sent to their slices."""
    order = np.lexsort((items["who"], items["slices"]))
    slices, who, counts = (items[c][order] for c in ("slices", "who", "counts"))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (slices[1:] != slices[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    slices, who, counts = slices[first], who[first], np.add.reduceat(counts, first)
    return [
        {"part": -1, "slice": int(slices[a]), "who": who[a:b].tobytes(), "counts": counts[a:b].tobytes()}
        for a, b in pk.cuts(slices)
    ]


def _answer(homes: int | None):
    """Per part: which rows of which slice hold a shingle that another slice holds too.

    Answers are addressed to the slice, or with ``homes`` bits to its coarse home.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part"]):
            if table["part"][0].as_py() < 0:
                yield from table.to_batches()
                continue
            pieces = [np.frombuffer(b, np.uint32) for b in table["shingles"].to_pylist()]
            slices, where = pk.owners(table, [len(p) for p in pieces])
            who = pk.column(table, "who", np.uint16)
            token = np.concatenate(pieces)
            order = np.argsort(token, kind="stable")
            token = token[order]
            same = token[1:] == token[:-1]
            again = np.zeros(len(token), dtype=bool)
            again[1:] |= same
            again[:-1] |= same
            order = order[again]
            order = order[who[order] != NOBODY]
            if not len(order):
                continue
            keys, counts = np.unique(where[order].astype(np.int64) << 16 | who[order], return_counts=True)
            owner, who = slices[keys >> 16], (keys & 65535).astype(np.uint16)
            counts = counts.astype(np.int64)
            if homes is None:
                out = [
                    {"part": -1, "slice": int(owner[a]), "who": who[a:b].tobytes(), "counts": counts[a:b].tobytes()}
                    for a, b in pk.cuts(owner)
                ]
            else:
                target = pk.home(owner, homes)
                order = np.argsort(target, kind="stable")
                target, owner, who, counts = target[order], owner[order], who[order], counts[order]
                out = [
                    {
                        "part": -1, "slice": int(target[a]), "slices": owner[a:b].tobytes(), "who": who[a:b].tobytes(),
                        "counts": counts[a:b].tobytes(),
                    }
                    for a, b in pk.cuts(target)
                ]
            yield pa.RecordBatch.from_pylist(out, _PACKED)

    return answer


def _tell(threshold: int):
    """Per slice: its rows, and whether enough of their shingles occur elsewhere."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["slice"]):
            told = {c: table[c].to_pylist() for c in table.column_names}
            at = next(k for k, ids in enumerate(told["ids"]) if ids is not None)
            ids, sizes, high, low, counts = (np.frombuffer(told[c][at], np.int64) for c in ("ids", "sizes", "high", "low", "counts"))
            counts = counts.copy()
            for who, more in zip(told["who"], told["counts"]):
                if who is not None:
                    counts[np.frombuffer(who, np.uint16)] += np.frombuffer(more, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=ids == -(1 << 63)), pa.array(sizes), pa.array(high), pa.array(low),
                    pa.array((sizes > 0) & (100 * counts >= threshold * sizes)),
                ],
                names=["id", "n", "high", "low", "may"],
            )

    return tell


def shared(rows: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, coarse: int = pk.COARSE) -> DataFrame:
    """(id, n, high, low, may) of (id, text): set size, its name, and whether it can have a link.

    Beyond ``2 ** coarse`` parts shingles and answers travel in two steps each.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // PART_BYTES).bit_length())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.mapInArrow(_ask(width, bits, coarse), PACKED)
    far = bits > coarse
    if far:
        kinds = {"who": np.uint16, "shingles": np.uint64}
        asked = pk.regather(asked, "part", "shingles", kinds, _deal(bits), _PACKED, PACKED, 2 * size, coarse)
    answered = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answer(coarse if far else None), PACKED)
    if far:
        kinds = {"who": np.uint16, "counts": np.int64}
        answered = pk.regather(answered, "slice", "slices", kinds, _return, _PACKED, PACKED, size, coarse)
    return (
        answered.repartition(parts, "slice").sortWithinPartitions("slice")
        .mapInArrow(_tell(threshold), "id long, n long, high long, low long, may boolean")
    )


def needed(a: int, b: int, threshold: int) -> int:
    """Smallest overlap of sets of sizes a and b with threshold percent of their union."""
    return -(-threshold * (a + b) // (100 + threshold))


class Node:
    __slots__ = ("segment", "begin", "children", "ends", "low", "high", "member", "mixed")

    def __init__(self, segment: np.ndarray, begin: int, size: int, member: int) -> None:
        self.segment, self.begin = segment, begin
        self.children: dict[int, Node] = {}
        self.ends: list[int] = []
        self.low = self.high = size
        self.member, self.mixed = member, False


class Trie:
    """Ordered sets in a path-compressed prefix tree, and the classes their links make."""

    def __init__(self, threshold: int, labels: list[int]) -> None:
        self.threshold = threshold
        self.parent = list(range(len(labels)))
        first: dict[int, int] = {}
        for k, label in enumerate(labels):  # classes known before
            self.union(k, first.setdefault(label, k))
        self.root = None
        self.stored: dict[int, np.ndarray] = {}

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def link(self, k: int, x: np.ndarray) -> None:
        """Join the class of ``k`` with those of all stored sets similar to ``x``."""
        if self.root is None:
            return
        size, t = len(x), self.threshold
        small_size, large_size = -(-t * size // 100), 100 * size // t
        least = needed(size, small_size, t)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if node.high < small_size or node.low > large_size:
                continue
            if not node.mixed and self.find(node.member) == self.find(k):
                continue
            segment = node.segment
            depth = node.begin + len(segment)
            if len(segment):
                place = np.searchsorted(x, segment)
                inside = place < size
                overlap += int(np.count_nonzero(x[place[inside]] == segment[inside]))
                at = int(np.searchsorted(x, segment[-1], "right"))
            best = max(node.low, min(node.high, depth + size - at, large_size))
            if overlap + min(size - at, best - depth) < needed(size, best, t):
                continue
            if node.ends and overlap >= needed(size, depth, t):
                for other in node.ends:
                    self.union(k, other)
            if node.children:
                # a child that begins behind this place of x leaves too little of it
                last = size - least + overlap
                following = node.children.get(int(x[at])) if at < size else None
                if last < size:
                    bound = int(x[last])
                    stack += [(c, overlap, at) for first, c in node.children.items() if first <= bound and c is not following]
                else:
                    stack += [(c, overlap, at) for c in node.children.values() if c is not following]
                if following is not None:
                    stack.append((following, overlap, at))

    def store(self, k: int, x: np.ndarray) -> None:
        size = len(x)
        if self.root is None:
            self.root = Node(x[:0], 0, size, k)
        node, at = self.root, 0
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if not node.mixed and self.find(node.member) != self.find(k):
                node.mixed = True
            if at == size:
                node.ends.append(k)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                leaf = Node(x[at:], at, size, k)
                leaf.ends.append(k)
                node.children[int(x[at])] = leaf
                return
            segment = child.segment
            shared = min(len(segment), size - at)
            differs = np.flatnonzero(segment[:shared] != x[at : at + shared])
            same = int(differs[0]) if len(differs) else shared
            if same < len(segment):
                upper = Node(segment[:same], at, child.low, child.member)
                upper.high, upper.mixed = child.high, child.mixed
                child.segment, child.begin = segment[same:], at + same
                upper.children[int(child.segment[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            node, at = child, at + same

    def classes(self, ids: list[int]) -> list[int]:
        """The smallest id of each set's class."""
        least: dict[int, int] = {}
        for k, i in enumerate(ids):
            root = self.find(k)
            least[root] = min(least.get(root, i), i)
        return [least[self.find(k)] for k in range(len(ids))]


def _join(threshold: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster", "block"]):
            ids, labels = table["id"].to_pylist(), table["label"].to_pylist()
            shingles = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
            trie = Trie(threshold, labels)
            for k in sorted(range(len(ids)), key=lambda k: (len(shingles[k]), ids[k])):
                trie.link(k, shingles[k])
                trie.store(k, shingles[k])
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks(), table["cluster"].combine_chunks(), table["label"].combine_chunks(),
                 pa.array(trie.classes(labels), pa.int64())],
                names=["id", "cluster", "label", "joined"],
            )

    return join


def _linked(grouped: DataFrame, threshold: int) -> DataFrame:
    """(id, cluster, label, joined) of rows (id, cluster, block, label, shingles): classes per block."""
    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        grouped.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block")
        .mapInArrow(_join(threshold), "id long, cluster long, label long, joined long")
    )


def _pack(width: int):
    """(doc, id, n, shingles): sets named by their fingerprint."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                hashes, bounds = sets(rows.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), pa.array(fingerprints(hashes, bounds)[0]), pa.array(np.diff(bounds)),
                        pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    ],
                    names=["doc", "id", "n", "shingles"],
                )

    return pack


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, id, n): one row per shingle of the sets."""
    for batch in batches:
        for rows in tx.slices(batch, "shingles"):
            packed = rows.column("shingles")
            sizes = rows.column("n").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(packed.to_pylist()), np.int64)),
                    pa.array(np.repeat(rows.column("id").to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(sizes, sizes)),
                ],
                names=["shingle", "id", "n"],
            )


def _prefixes(packed: DataFrame, threshold: int) -> DataFrame:
    """(key, id): the prefix shingles of each set, rare ones first, in its size class and the next.

    Similar sets share one of their first n - threshold% of n + 1 shingles in any one order. The rarest
    come first, so a passage that many sets hold is in a prefix only where it fills the set. Shingles of
    one set alone take the first places and match nothing.
    """
    each = packed.mapInArrow(_shingles, "shingle long, id long, n long")
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(often, "shingle")
    own = W.partitionBy("id")
    place = F.row_number().over(own.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(own)
    prefix = held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)
    size_class = F.floor(F.log("n") / F.log(F.lit(CLASS * 100 / threshold)))
    return prefix.select(F.explode(F.array(size_class, size_class + 1)).alias("class"), "shingle", "id").select(
        F.xxhash64("shingle", "class").alias("key"), "id"
    )


def _stars(keyed: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) from every ``name`` to the smallest ``name`` of each of its keys."""
    least = keyed.groupBy("key").agg(F.min(name).alias("b"), F.max(name).alias("top")).where("b <> top").select("key", "b")
    return keyed.join(least, "key").where(F.col(name) != F.col("b")).select(F.col(name).alias("a"), "b").distinct()


def links(packed: DataFrame, threshold: int = THRESHOLD, limit: int = TRIE_SHINGLES) -> DataFrame:
    """(id, component) of the distinct sets (id, n, shingles) that link with another one."""
    keyed = durable(_prefixes(packed, threshold))
    clusters = durable(components(_stars(keyed, "id")))
    member = packed.join(clusters, packed["id"] == clusters["node"]).select(
        "id", "n", "shingles", F.col("component").alias("cluster"), F.col("id").alias("label")
    )
    sizes = durable(member.groupBy("cluster").agg(F.sum("n").alias("total")))
    blocks = F.ceil(F.col("total") / limit).cast("long")
    first = member.join(small(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(blocks, F.lit(1))))
    joined = durable(_linked(first.select("id", "cluster", "block", "label", "shingles"), threshold))
    large = sizes.where(F.col("total") > limit).select("cluster")
    found = joined.select("id", "cluster", F.col("joined").alias("label"))
    if large.isEmpty():
        return found.select("id", F.col("label").alias("component"))
    return _across(packed, found, durable(large), keyed, threshold, limit)


def _across(packed: DataFrame, found: DataFrame, large: DataFrame, keyed: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Classes of clusters that went in blocks.

    Delegates of the classes meet first, which joins the blocks of one large class at little cost.
    Then every pair of different classes that share a prefix shingle is compared exactly.
    """
    split = durable(found.join(large, "cluster", "left_semi"))
    # at most DELEGATES sets of a class, whatever its size
    chosen = split.groupBy("cluster", "label", F.pmod(F.xxhash64("id"), F.lit(DELEGATES)).alias("d")).agg(F.min("id").alias("id"))
    rows = durable(packed.join(small(durable(chosen)), "id").select("id", "n", "cluster", "label", "shingles"))
    size = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / limit).cast("long").alias("blocks"))
    dealt = rows.join(small(durable(size)), "cluster").withColumn("block", F.pmod(F.xxhash64("label"), "blocks"))
    met = durable(_linked(dealt.select("id", "cluster", "block", "label", "shingles"), threshold))
    renamed = met.select(F.col("label").alias("a"), F.col("joined").alias("b")).where("a <> b").distinct()
    split = durable(_relabel(split, renamed))
    apart = keyed.join(split, "id").select("key", "id", "label").distinct()
    several = apart.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    apart = durable(apart.join(several, "key", "left_semi"))
    left, right = (apart.select("key", F.col("id").alias(f"id_{s}"), F.col("label").alias(s)) for s in "ab")
    pairs = left.join(right, "key").where("a < b").select("id_a", "id_b", "a", "b").distinct()
    sized = packed.select("id", "n", "shingles")
    full = (
        pairs.join(sized.toDF("id_a", "n_a", "s_a"), "id_a").join(sized.toDF("id_b", "n_b", "s_b"), "id_b")
        .where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    )
    edges = full.select("a", "b", "s_a", "s_b").mapInArrow(_similar(threshold), "a long, b long")
    whole = found.join(large, "cluster", "left_anti").unionByName(split)
    return _relabel(whole, edges).select("id", F.col("label").alias("component"))


def _relabel(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``label`` replaced by the smallest label that ``edges`` reach."""
    merged = components(edges)
    return rows.join(merged, rows["label"] == merged["node"], "left").select(
        "id", "cluster", F.coalesce("component", "label").alias("label")
    )


def _similar(threshold: int):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("s_a", "s_b"))
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return similar


def _classes(
    docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, threshold: int = THRESHOLD, limit: int = TRIE_SHINGLES
) -> DataFrame:
    """(id, high, low, n, component, component_id) per row; ``component`` names the class, null without words."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    named = durable(shared(rows, width, threshold))
    # copies of one set are one set from here on, named by its fingerprint
    equal = durable(
        named.where("n > 0").groupBy("high", "low", "n").agg(F.min("id").alias("first"), F.max("may").alias("may"))
    )
    first = equal.where("may and first is not null").select(F.col("first").alias("id")).distinct()
    texts = rows.join(small(first), "id", "left_semi")
    nameless = not equal.where("may and first is null").isEmpty()
    if nameless:  # only their fingerprints name sets without an id
        texts = texts.unionByName(rows.where("id is null"))
    texts = durable(texts)
    # among different sets, many of which had only copies of their own
    again = durable(shared(texts, width, threshold).where("may"))
    chosen = again.join(equal.select("high", "low", "n", "first"), ["high", "low", "n"]).where("id <=> first").select(
        F.col("id").alias("doc"), F.col("high").alias("id")
    ).distinct()
    every = texts.mapInArrow(_pack(width), "doc long, id long, n long, shingles binary")
    packed = every.join(small(chosen), ["doc", "id"]).select("id", "n", "shingles")
    if nameless:
        alone = every.where("doc is null").join(small(chosen.where("doc is null").select("id")), "id")
        packed = packed.unionByName(alone.select("id", "n", "shingles").dropDuplicates(["id"]))
    packed = durable(packed)
    linked = links(packed, threshold, limit).groupBy("id").agg(F.min("component").alias("component"))
    labelled = durable(
        equal.join(linked, equal["high"] == linked["id"], "left")
        .select("high", "low", "n", "first", F.coalesce("component", "high").alias("component"))
    )
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    component = labelled.join(least, "component").select("high", "low", "n", "component", "component_id")
    return named.join(component, ["high", "low", "n"], "left").select(
        "id", "high", "low", "n", "component", F.coalesce("component_id", "id").alias("component_id")
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id) per row; options are width, threshold and limit."""
    return _classes(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def _named(width: int):
    """(id, text_hash, high, low, n): rows named by their text and by their set."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, "text", SLICE_BYTES):
                hashes, bounds = sets(rows.column("text"), width)
                high, low = fingerprints(hashes, bounds)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("text_hash"), pa.array(high), pa.array(low), pa.array(np.diff(bounds))],
                    names=["id", "text_hash", "high", "low", "n"],
                )

    return name


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, one with the smallest id; rows without an id or words stay.

    A row whose id others have too is judged by its own text. Columns are carried whatever their names.
    """
    names = docs.columns
    short = docs.toDF(*(f"c{k}" for k in range(len(names))))
    return _distinct(short, f"c{names.index(id_col)}", f"c{names.index(text_col)}", **options).toDF(*names)


def _distinct(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    found = _classes(docs, id_col, text_col, **options)
    repeated = durable(found.where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    several = not repeated.isEmpty()
    if several:
        found = durable(found)
    gone = durable(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("gone_")).distinct())
    if not several:
        return docs.join(small(gone), docs[id_col] == F.col("gone_"), "left_anti")
    apart = repeated.select(F.col("id").alias("gone_"))
    once = docs.join(small(durable(gone.unionByName(apart).distinct())), docs[id_col] == F.col("gone_"), "left_anti")
    names = docs.columns
    text_hash = F.xxhash64(docs[text_col], F.lit(1))
    rows = docs.join(small(apart), docs[id_col] == F.col("gone_"), "left_semi")
    texts = rows.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), text_hash.alias("text_hash"))
    told = texts.mapInArrow(_named(options.get("width", WIDTH)), "id long, text_hash long, high long, low long, n long").distinct()
    # a class keeps one of the texts that its smallest id has
    judged = told.join(
        found.join(small(repeated), "id", "left_semi").distinct(), ["id", "high", "low", "n"]
    ).where("n = 0 or id = component_id")
    best = judged.where("n > 0").groupBy("component").agg(F.min(F.struct("high", "low", "n", "text_hash")).alias("best"))
    chosen = judged.join(best, "component", "left").where(
        "n = 0 or (high = best.high and low = best.low and n = best.n and text_hash = best.text_hash)"
    )
    chosen = durable(chosen.select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), (F.col("n") == 0).alias("free_")))
    held = rows.join(small(chosen), (docs[id_col] == F.col("id_")) & (text_hash == F.col("hash_")))
    order = W.partitionBy("id_", "hash_").orderBy(F.xxhash64(*(docs[c] for c in names)))
    one = held.withColumn("place_", F.row_number().over(order)).where("free_ or place_ = 1")
    return once.unionByName(one.select(*(docs[c] for c in names)))
