"""Merkle manifest of a dataset: levels kept as concatenated hex strings of aligned blocks.

Every row has a leaf, the sha256 of its columns. Rows stand by group and order column; ``block``
consecutive nodes of a group form one row of a table, which keeps each of its levels as one hex
string. Fixed-width substrings of a level hash to the parents' string; the substrings to the left and
right of a node are its sibling segments. The tops of the blocks are the nodes of the next round, until
every group has one root; the groups' roots, by group, form one more such tree.

Paths come back down the same tables: a block learns the path above its top once, and its rows add their
own segments, so paths are neither shuffled nor stored per row.

Places are counted on range-partitioned pieces, so a group of any size is spread; a task holds one block.
All tables between the rounds are written to the checkpoint folder.

Defined results: a null value is written ``-`` and differs from an empty one; rows with a null order
value stand first, rows with equal ones by their leaves, and identical rows take places among each
other at will; a null group is the first one; a group of one row has its leaf as root; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayfinder.session import durable, sized

FANOUT = 2
BLOCK = 256
DIGEST = 64
PIECE_ROWS = 500_000
# Rows that one window may number; more go in sorted ranges.
WINDOW_ROWS = 4_096
# Blocks written to one file.
FILE_BLOCKS = 1_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


@dataclass
class Nodes:
    """(key, pos, size, digest, payload) rows; ``pos`` runs from 0 within a key of ``size`` rows."""

    rows: DataFrame
    total: int
    largest: int


def numbered(nodes: DataFrame, order: Sequence[str], piece_rows: int = PIECE_ROWS, window_rows: int = WINDOW_ROWS) -> Nodes:
    """Number written (key, ...) rows within ``key`` by ``order``.

    Sorted ranges of all rows are written with a running number, from which each row's place in its range
    follows; a range's first place in a key comes from the counts of the ranges before it.
    """
    total = nodes.count()
    whole = Window.partitionBy("key")
    if total <= window_rows:
        placed = durable(nodes.select(
            "*", (F.row_number().over(whole.orderBy(*order)) - 1).cast("long").alias("pos"),
            F.count("*").over(whole).alias("size"),
        ).coalesce(1))
        return Nodes(placed, total, placed.agg(F.max("size")).first()[0] or 0)
    pieces = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // piece_rows))
    # identical rows are spread by a running number; ``nodes`` is written, so it is the same in reruns
    ranged = nodes.repartitionByRange(pieces, "key", *order, F.monotonically_increasing_id())
    cut = durable(ranged.sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33)
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        cut.groupBy("key", piece.alias("piece")).agg(F.count("*").alias("n"), F.min("at").alias("first")).select(
            "key", "piece", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("move"),
            F.sum("n").over(whole).alias("size"),
        ).coalesce(-(-(total // piece_rows + pieces) // FILE_BLOCKS))
    )
    placed = cut.withColumn("piece", piece).join(sized(offsets), ["key", "piece"])
    rows = placed.select(*nodes.columns, (F.col("at") + F.col("move")).alias("pos"), "size")
    return Nodes(rows, total, offsets.agg(F.max("size")).first()[0] or 0)


def _upto(count: Column) -> Column:
    """0 .. count - 1, empty for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _parents(level: Column, fanout: int) -> Column:
    width = DIGEST * fanout
    runs = F.ceil(F.octet_length(level) / width)
    hashed = F.transform(_upto(runs), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashed, "").cast("binary")


def _depth(nodes: int, fanout: int) -> int:
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def blocks(nodes: Nodes, payload: Sequence[str], fanout: int, block: int) -> DataFrame:
    """(key, block, size, height, rows, levels): every ``block`` consecutive nodes of a key.

    ``levels`` holds the hex strings from the nodes up to the block's top, as bytes, which substrings
    reach without a walk along the characters. A group of several blocks lifts each by the same height.
    """
    full = _depth(block, fanout)
    # levels that a group of one block needs: as many as powers of the fan-out lie below its size
    own = sum((F.when(F.col("size") > fanout**j, 1).otherwise(0) for j in range(full)), F.lit(0))
    grouped = nodes.rows.groupBy("key", "size", F.floor(F.col("pos") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("rows")
    )
    base = F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary")
    levels = F.aggregate(
        _upto(F.col("height")), F.array(base),
        lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fanout))),
    )
    files = max(1, nodes.total // (block * FILE_BLOCKS))
    if files < nodes.rows.sparkSession.sparkContext.defaultParallelism and nodes.total <= block * FILE_BLOCKS // 8:
        grouped = grouped.coalesce(files)
    return durable(
        grouped.withColumn("height", F.when(F.col("size") > block, full).otherwise(own)).withColumn("levels", levels)
    )


def _segments(place: Column, fanout: int) -> Column:
    """What stands left and right of a node in its run, level by level up to the block's top."""

    def at(j: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(fanout)), j)).cast("int")
        first = node - node % fanout
        level = F.get("levels", j)
        return F.struct(
            F.substring(level, first * DIGEST + 1, (node - first) * DIGEST).cast("string").alias("left"),
            F.substring(level, (node + 1) * DIGEST + 1, (first + fanout - 1 - node) * DIGEST).cast("string").alias("right"),
        )

    return F.transform(_upto(F.col("height")), at)


@dataclass
class Tree:
    """Blocks of every round, from the leaves to the last one that a group needs."""

    rounds: list[DataFrame]
    payload: list[str]
    fanout: int
    block: int

    def roots(self) -> DataFrame:
        """(key, round, digest): one row per group, and the round that its root comes from."""
        tops = F.decode(F.element_at("levels", -1), "UTF-8").alias("digest")
        done = [r.where(F.col("size") <= self.block).select("key", F.lit(k).alias("round"), tops) for k, r in enumerate(self.rounds)]
        return reduce(DataFrame.unionByName, done)

    def paths(self, above: DataFrame) -> DataFrame:
        """(key, pos, digest, payload, path, more columns of ``above``) of every node of the first round.

        ``above`` gives (key, round, path, ...): what lies beyond each group's root, whose one block is
        the last of its round.
        """
        carried = [c for c in above.columns if c not in ("key", "round", "path")]
        found = None
        for k in range(len(self.rounds) - 1, -1, -1):
            known = above.where(F.col("round") == k).select("key", F.lit(0).cast("long").alias("block"), F.col("path").alias("upper"), *carried)
            if found is not None:
                known = known.unionByName(found.select("key", F.col("pos").alias("block"), F.col("path").alias("upper"), *carried))
            payload = self.payload if k == 0 else []
            members = F.transform(
                "rows", lambda r: F.struct(
                    r["pos"].alias("pos"), r["digest"].alias("digest"), *(r[p].alias(p) for p in payload),
                    _segments(r["pos"] % self.block, self.fanout).alias("own"),
                ),
            )
            found = (
                self.rounds[k].join(known, ["key", "block"])
                .select("key", "upper", *carried, F.explode(members).alias("m"))
                .select("key", "m.pos", "m.digest", *(f"m.{p}" for p in payload),
                        F.concat("m.own", "upper").alias("path"), *carried)
            )
        return found


def tree(nodes: Nodes, payload: Sequence[str] = (), fanout: int = FANOUT, block: int = BLOCK) -> Tree:
    """The tree of each key's nodes."""
    if fanout < 2 or fanout ** _depth(block, fanout) != block:
        raise ValueError("block must be a power of the fan-out, which is 2 or more")
    rounds = [blocks(nodes, payload, fanout, block)]
    total, largest = nodes.total, nodes.largest
    while largest > block:
        # every group of several blocks holds more nodes than a block, so rounds shrink by half at least
        total, largest = 2 * total // block, -(-largest // block)
        tops = rounds[-1].where(F.col("size") > block).select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("size") / block).alias("size"),
            F.decode(F.element_at("levels", -1), "UTF-8").alias("digest"),
        )
        rounds.append(blocks(Nodes(tops, total, largest), [], fanout, block))
    return Tree(rounds, list(payload), fanout, block)


def manifest(
    docs: DataFrame, columns: Sequence[str], group_col: str, order_col: str, forged: dict[str, Column] | None = None,
    fanout: int = FANOUT, block: int = BLOCK, piece_rows: int = PIECE_ROWS, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """(id, group, leaf, altered, path, subroot, root) per row: the whole manifest with its proofs.

    ``path`` lists the (left, right) siblings from the leaf to the root. ``altered`` is the leaf of the
    row with the values of ``forged`` in place of its own.
    """
    forged = forged or {}
    group = docs[group_col].cast("string")
    rows = durable(docs.select(
        # the mark keeps null apart from empty and in front of it; strings compare by their bytes
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"),
        docs[order_col].alias("id"),
        leaf([docs[c] for c in columns]).alias("digest"),
        leaf([forged.get(c, docs[c]) for c in columns]).alias("altered"),
    ))
    lower = tree(numbered(rows, ["id", "digest"], piece_rows, window_rows), ["id", "altered"], fanout, block)
    tops = durable(lower.roots().select(F.lit("").alias("key"), F.col("key").alias("id"), "round", "digest"))
    upper = tree(numbered(tops, ["id"], piece_rows, window_rows), ["id", "round"], fanout, block)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    top = upper.roots().select("key", F.col("round"), nothing.alias("path"), F.col("digest").alias("root"))
    above = durable(upper.paths(top).select(F.col("id").alias("key"), "round", "path", F.col("digest").alias("subroot"), "root"))
    return lower.paths(above).select(
        "id", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("group"),
        F.col("digest").alias("leaf"), "altered", "path", "subroot", "root",
    )


def proof(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
