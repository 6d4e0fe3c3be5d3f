"""Byte-string removal against brute force, and the front-coded merge against sorting."""

import hashlib
import random
from collections import Counter

import pytest

from strayfinder.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, k1 string, codes int"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for i, r in enumerate(raw):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(length, seed=1):
    rng = random.Random(seed)
    say = lambda n, letters="abcdefghé ": "".join(rng.choice(letters) for _ in range(n))
    shared = [say(rng.randrange(length - 3, 4 * length)) for _ in range(8)]
    texts = [None, "", "a", "a" * (length - 1), "a" * length, "ab" * (3 * length), "a" * (length + 1)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(say(rng.randrange(0, 2 * length)))
            if rng.random() < 0.7:
                s = rng.choice(shared)
                a = rng.randrange(0, len(s) // 2)
                s = s[a : len(s) - rng.randrange(0, len(s) // 3)]
                if rng.random() < 0.3:
                    k = rng.randrange(len(s))
                    s = s[:k] + "Z" + s[k + 1 :]
                parts.append(s)
        texts.append("".join(parts))
    texts += [texts[12]] * 4 + [texts[20] + "x", say(30 * length), say(20 * length, "ab")]
    # one passage at the edge of which many contexts meet
    texts += [say(rng.randrange(length)) + shared[0] + say(rng.randrange(length)) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("length, hot", [(200, sd.HOT), (40, sd.HOT), (40, 3)])
def test_removal(spark, length, hot, monkeypatch):
    texts = corpus(length)
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(6)
    rows = sd.dedup(docs, length=length, hot=hot).collect()
    assert sorted(tuple(r) for r in rows) == brute(texts, length)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(sd, "_small", lambda rows, size: rows)
    texts = corpus(40, seed=5)
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in sd.dedup(docs, length=40).collect()) == brute(texts, 40)


def test_one_slice_and_empty(spark):
    texts = corpus(40, seed=9)
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in sd.dedup(docs, length=40).collect()) == brute(texts, 40)
    assert sd.dedup(docs.limit(0)).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(7)]
    coded = [sd.front_code(r) for r in runs]
    assert [[s for _, s in sd.front_decode(*c)] for c in coded] == runs

    def entries(k):
        return ((n, s, k) for n, s in sd.front_decode(*coded[k]))

    merged = list(sd.LoserTree([entries(k) for k in range(7)]))
    assert [s for _, s, _ in merged] == sorted(s for r in runs for s in r)
    for (_, a, _), (n, b, _) in zip(merged, merged[1:]):
        assert n == sd.common(a, b, 0)
