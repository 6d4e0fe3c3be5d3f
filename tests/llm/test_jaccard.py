"""The n-gram join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from strayfinder.llm import jaccard
from strayfinder.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, n_shingles string, component_id int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(k, len(s), find(k)) for k, s in enumerate(sets)]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzÉé") + str(rng.randrange(60))
    texts = ["", None, " \t\n", "one", "One", "one two", "one  two\n", "a b c d e", "a b c d E", "é x a"]
    for _ in range(14):
        base = [word() for _ in range(rng.choice([8, 30, 60, 90]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [word()], [copy[k], word()]])
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    texts += [" ".join(["same"] * 5000), " ".join(["same"] * 7)]
    chain = [word() for _ in range(50)]
    for k in range(20):  # neighbours link, ends don't
        texts.append(" ".join([f"n{j}" if j < 2 * k else w for j, w in enumerate(chain)]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limit", [jaccard.TRIE_SHINGLES, 300])
def test_classes(spark, limit):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    rows = jaccard.classes(docs, limit=limit).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(texts)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "small", lambda rows: rows)
    texts = corpus(seed=8)
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = jaccard.classes(docs, limit=300).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(texts)


def test_odd_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text, "", 1), (5, text, "", 1), (None, text, "", 1), (3, text + " i", "", 1), (9, "x", "", 1), (None, "alone", "", 1)], SCHEMA)
    rows = sorted(((str(r.doc_id), r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    assert rows == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", 3), ("None", None)]
    kept = sorted(str(r.doc_id) for r in jaccard.distinct(docs).collect())
    assert kept == ["3", "9", "None", "None"]
    assert jaccard.distinct(docs).columns == docs.columns
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(3, text), (3, text), (3, text + " x"), (5, text + " y"), (5, "only this id has such words at all"), (5, ""), (5, ""),
            (7, "seven has its own text too"), (7, "seven has its OWN text  too"), (8, "seven has its own text too"), (9, "x")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard.distinct(docs).collect()]
    assert sorted((i, "" if i == 3 else t.lower().split()[0] if t else "") for i, t in kept) == [
        (3, ""), (5, ""), (5, ""), (5, "only"), (7, "seven"), (9, "x")]
    assert jaccard.distinct(docs).columns == docs.columns


def test_chain_through_sets_without_id(spark):
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([f"n{j}" if j < 8 * k else w for j, w in enumerate(words)]) for k in range(3)]
    rows = [(3, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted(((str(r.doc_id), r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    assert got == [("3", 3), ("7", 3), ("None", 3), ("None", 3), ("None", None), ("None", None)]


@pytest.mark.parametrize("threshold", [60, 95])
def test_other_thresholds(spark, threshold):
    words = [f"w{k}" for k in range(200)]
    # sizes 60 and 97 share 61.9 percent and are more than two steps of 1.26 apart
    texts = [" ".join(words[:64]), " ".join(words[:101]), *corpus(seed=5)]
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = [low if p == high else p for p in least]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, threshold=threshold).collect()}
    assert got == dict(enumerate(least))


def test_trie_matches_pairs():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.sort(rng.choice(base, rng.integers(30, 60), replace=False)) for _ in range(60)]
    trie = jaccard.Trie(80, list(range(60)))
    for k, x in enumerate(sets):
        trie.link(k, x)
        trie.store(k, x)
    parent = list(range(60))
    for a in range(60):
        for b in range(60):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    assert trie.classes(list(range(60))) == parent


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200)] + [(300, j) for j in range(301, 350)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {200: 200, 201: 200} | {k: 300 for k in range(300, 350)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
