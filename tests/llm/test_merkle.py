"""The manifest against plain Python from the definition."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strayfinder.llm import merkle
from strayfinder.llm.queries import op11

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and each node's (left, right) siblings by level."""
    paths: list[list] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, members = [], []
        for low in range(0, len(nodes), fanout):
            run = nodes[low : low + fanout]
            for k in range(len(run)):
                for i in under[low + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha("".join(run)))
            members.append([i for k in range(len(run)) for i in under[low + k]])
        nodes, under = parents, members
    return nodes[0], paths


def expected(rows: list[tuple], fanout: int = 2) -> Counter:
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        more = n_chars is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        altered = sha("".join(map(field, (doc_id, source, lang, n_chars + 1 if more else n_chars, text))))
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, altered, doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = {g: climb([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in order}
    root, above = climb([lower[g][0] for g in order], fanout) if order else ("", [])
    out = Counter()
    for g, more in zip(order, above):
        for row, own in zip(sorted(groups[g], key=lambda r: r[:3]), lower[g][1]):
            node, path = row[3], own + more
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path))
            out[(row[4], row[2], lower[g][0], root, proof, node, node == root)] += 1
    return out


def got(spark, rows, fanout=2, block=4, piece_rows=3, window_rows=0, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for name in ("key", "pos", "size", "digest", "levels", "path", "id", "root"):
            docs = docs.withColumn(name, F.lit("x"))
    added = docs["n_chars"] + F.when(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, 1).otherwise(0)
    out = merkle.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": added}, fanout, block, piece_rows, window_rows
    ).withColumn("folded", merkle.folded(F.col("altered"), F.col("path")))
    picked = out.select("id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded", F.expr("folded = root"))
    return Counter(tuple(r) for r in picked.collect())


ROWS = (
    [(i, f"text {i}" * (i % 5), "en", "s", i) for i in range(41)]
    + [(i, "é€", "fr", None, None) for i in range(100, 105)]
    + [(7, "lone", "de", "s", 4), (9, None, None, "s", 0), (None, "", None, "s", 1), (None, None, None, None, None), (3, "", "", "", 3)]
    + [(50, "copy", "en", "s", 4)] * 6
    + [(50, "other", "en", "s", 4), (-21, "minus", "es", "t", 5), (1 << 62, "wide", "es", "t", 5)]
)


@pytest.mark.parametrize("fanout, block, count", [(2, 4, None), (2, 256, None), (3, 9, None), (2, 4, 1), (2, 4, 2)])
def test_manifest_equals_definition(spark, fanout, block, count):
    rows = ROWS[:count]
    assert got(spark, rows, fanout, block, extra=True) == expected(rows, fanout)


def test_window_numbers_alike(spark):
    assert got(spark, ROWS, window_rows=1000) == expected(ROWS)


@pytest.mark.parametrize("window_rows", [0, 1000])
def test_empty_table(spark, window_rows):
    assert got(spark, [], window_rows=window_rows) == Counter()


def test_block_must_fit_the_fanout(spark):
    with pytest.raises(ValueError):
        got(spark, ROWS[:3], fanout=3, block=4)


def test_query_on_a_table(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in found.collect()) == expected(ROWS)
