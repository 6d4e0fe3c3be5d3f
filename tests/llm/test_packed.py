"""The two-step exchange of packed records against the one-step one, and the size of its records."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strayfinder.llm import jaccard, packed, suffix_dedup


def texts(seed=2):
    rng = random.Random(seed)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    common = [say(60) for _ in range(6)]
    return [None, "", " ", "one"] + [" ".join([say(rng.randrange(1, 80)), rng.choice(common), say(rng.randrange(40))]) for _ in range(300)]


@pytest.fixture
def small_slices(monkeypatch):
    for module in (jaccard, suffix_dedup):
        monkeypatch.setattr(module, "SLICE_BYTES", 4_000)


@pytest.mark.parametrize("hold", [packed.HOLD_BYTES, 500])
def test_two_steps_tell_the_same(spark, small_slices, monkeypatch, hold):
    monkeypatch.setattr(packed, "HOLD_BYTES", hold)
    monkeypatch.setattr(packed, "TASK_BYTES", 2_000)
    docs = spark.createDataFrame(list(enumerate(texts())), "id bigint, text string").repartition(5, "id")
    one, two = (sorted(map(tuple, jaccard.shared(docs, threshold=40, coarse=c).collect())) for c in (10, 2))
    assert one == two and any(r[-1] for r in one) and not all(r[-1] for r in one)
    rows = docs.selectExpr("coalesce(text, '') AS text", "id AS k1", "-id AS k2")
    one, two = (
        sorted((r.k1, r.copies, bytes(r.codes)) for r in suffix_dedup.asked(rows, 200, 20, coarse=c).collect()) for c in (10, 2)
    )
    assert one == two and len(one) > 100


@pytest.mark.parametrize("bits", [4, 10, 16, 23])
def test_records_stay_large(bits):
    """A corpus of any size sends no more records per shingle than one of 2 ** COARSE parts."""
    rng = np.random.default_rng(1)
    token = np.sort(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) << np.uint64(1))
    first = packed.place(token, packed.first_bits(bits))
    assert sum(1 for _ in packed.cuts(first)) <= 1 << packed.COARSE
    if bits <= packed.COARSE:
        return
    # what one coarse part holds when HOLD_BYTES of it have met
    n = packed.HOLD_BYTES // 8
    inside = np.sort(rng.integers(0, 1 << (64 - packed.COARSE), n, dtype=np.uint64))
    dealt = jaccard._deal(bits)({"shingles": inside, "who": np.zeros(n, np.uint16), "slices": np.zeros(n, np.int64)})
    assert sum(len(r["shingles"]) for r in dealt) == 4 * n
    assert len(dealt) <= max(1, n // 300)


def test_joined_is_bounded_and_whole():
    rows = [{"k": k // 7, "b": bytes(10) if k % 5 else None, "at": k} for k in range(100)]
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 9]) for a in range(0, 100, 9)]
    tables = list(packed.joined(iter(batches), "k", "b", 30))
    assert [r["at"] for t in tables for r in t.to_pylist()] == list(range(100))
    assert all(len(set(t["k"].to_pylist())) == 1 for t in tables)
    assert all(sum(len(b or b"") for b in t["b"].to_pylist()) <= 30 for t in tables)
