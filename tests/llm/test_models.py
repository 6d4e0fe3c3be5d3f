"""Classifiers: held-out quality, calibration, compression windows and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayfinder.llm import quality_model as qm, toxicity as tox
from strayfinder.llm.calibration import calibrate, held_out, isotonic, training
from tests.llm.helpers import auc

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, score string, label string"
LABELS = "doc_id bigint, quality int, toxic int"


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    x = np.arange(60.0)
    n = rng.integers(1, 9, 60).astype(float)
    good = np.minimum(n, rng.integers(0, 9, 60))
    knots, values = isotonic(x, good, n)
    assert (np.diff(values) > 0).all()
    y = good / n
    # the fit at a point is the max over starts of the min over ends of block means
    want = [
        max(min((n[a : b + 1] * y[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(k, 60)) for a in range(k + 1))
        for k in range(60)
    ]
    got = np.repeat(values, [len(g) for g in np.split(np.arange(60), np.flatnonzero(np.diff(want) > 1e-12) + 1)])
    assert got == pytest.approx(want)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = qm.classify(docs, labels).join(labels, F.col("id") == labels["doc_id"]).where(held_out(F.col("id"))).toPandas()
    assert auc(rows["score"], rows["quality"]) > 0.97
    assert ((rows["score"] >= 0.3) == (rows["quality"] == 1)).mean() > 0.95


def test_normal_equations(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.normal(size=len(qm.STATISTICS))), int(rng.random() < 0.5)) for k in range(80)]
    schema = "id long, " + ", ".join(f"{s} double" for s in qm.STATISTICS) + ", label int"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    features = qm.Features.of(frame, 20, 3.0, 1)
    x = np.array([r[1:-1] for r in rows])
    assert features.mean == pytest.approx(x.mean(axis=0)) and features.scale == pytest.approx(x.std(axis=0))
    z, y = features(x), np.array([r[-1] for r in rows])
    penalty = np.diag([1e-6 * 80] + [0.01 * 80] * 20)
    assert qm.solve(frame, features, 0.01) == pytest.approx(np.linalg.solve(z.T @ z + penalty, z.T @ y))


def toxic_corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeghilnorstu") for _ in range(rng.randrange(2, 8)))
    bad = ["vileword", "nastything", "grimslur"]
    rows, labels = [], []
    for k in range(300):
        words = [word() for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(60), rng.choice(bad))
        rows.append((k, " ".join(words), "clash", "x"))
        labels.append((k, 1, int(toxic)))
    copied = " ".join(word() for _ in range(60))
    rows += [(400 + k, copied, "", "") for k in range(40)]
    labels += [(400 + k, 1, 1) for k in range(40)]  # copies must not make their words toxic terms
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(901, None, "", ""), (902, "", "", ""), (5, rows[5][1], "", ""), (903, "vileword " * 4000, "", "")]
    labels += [(5, 1, 1), (None, 1, 1), (7, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    out = tox.classify(docs, marks)
    assert out.count() == len(rows)
    scores = {r.id: r.score for r in out.collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    held = [r for r in spark.range(300).where(held_out(F.col("id"))).collect()]
    got = np.array([scores[r.id] for r in held])
    assert auc(got, np.array([r.id % 4 == 0 for r in held])) > 0.95
    assert scores[903] > 0.5 and scores[901] == scores[902]
    taught = docs.join(marks.select(F.col("doc_id").alias("d"), F.col("toxic").alias("t")), F.col("doc_id") == F.col("d"))
    terms = tox.marked_terms(taught.select(F.col("doc_id").alias("id"), F.col("t").alias("label"), "text"))
    assert {t for t in terms if not t.endswith("*")} == {"vileword", "nastything", "grimslur"}


def test_gains_from_the_definition(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeg") for _ in range(rng.randrange(2, 8)))
    texts = [None, "", "x", "Grimslur AÉ " * 9] + [" ".join(word() for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    texts += [t.replace("ab", "grimslur") for t in texts[4:20]]
    dictionaries = tox.Dictionaries(b"abe gad bade deg " * 9, b" grimslur " + b"abe gad bade deg " * 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in tox.gains(docs, dictionaries).collect()}
    ordinary, toxic = dictionaries.compressors()
    for k, text in enumerate(texts):
        pieces = tox.windows((text or "").encode().lower())
        saved = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in pieces]
        assert got[k].windows == len(saved)
        for (clear, prior), value in zip(tox.WHOLE, got[k].whole):
            weighted = [n + max(n - clear, 0) for n in saved]
            assert value == pytest.approx(sum(weighted) / (len(saved) + prior))
        for (clear, drift), value in zip(tox.RUNS, got[k].run):
            weighted = [n + max(n - clear, 0) - drift for n in saved]
            sums = [sum(weighted[i:j]) for i in range(len(saved)) for j in range(i, len(saved) + 1)]
            assert value == pytest.approx(max(sums, default=0) / np.log(len(saved) + 5))


def test_settings_are_those_that_order_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        values, labels = rng.integers(0, 6, 30).astype(float), rng.integers(0, 2, 30)
        pairs = [(a > b) + (a == b) / 2 for a in values[labels == 1] for b in values[labels == 0]]
        assert tox.ordering(values, labels) == pytest.approx(np.mean(pairs) if pairs else 0.5)


def test_one_toxic_passage_in_a_long_text(spark):
    rows, labels = toxic_corpus()
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdeghilnorstu") for _ in range(rng.randrange(2, 8)))
    clean = [word() for _ in range(8000)]
    passage = [w for _ in range(12) for w in (rng.choice(["vileword", "nastything", "GRIMSLUR"]), word())]
    rows += [(950, " ".join(clean), "", ""), (951, " ".join(clean[:4000] + passage + clean[4000:]), "", "")]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    scores = {r.id: r.score for r in tox.classify(docs, marks).collect()}
    assert scores[950] < 0.5 <= scores[951]


def test_windows_cover_the_text():
    rng = random.Random(0)
    for _ in range(200):
        data = "".join(rng.choice("ab \n") for _ in range(rng.randrange(300))).encode()
        pieces = tox.windows(data)
        assert b"".join(p[1:] for p in pieces) == data and all(1 < len(p) <= tox.WINDOW + 1 for p in pieces)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None), (None, 1, 1)]])
def test_missing_classes(spark, marks):
    docs = spark.createDataFrame([(k, f"some words {k}", "", "") for k in range(4)] + [(None, None, "", "")], SCHEMA)
    labels = spark.createDataFrame(marks, LABELS)
    assert {0 <= r.score <= 1 for r in qm.classify(docs, labels).collect()} == {True}
    assert {0 <= r.score <= 1 for r in tox.classify(docs, labels).collect()} == {True}
    assert qm.classify(docs.limit(0), labels).count() == tox.classify(docs.limit(0), labels).count() == 0


def test_training_rows_are_bounded_and_never_held_out(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(5000)], LABELS)
    rows = training(labels, "doc_id", "toxic", 1000)
    assert 800 < rows.count() < 1200
    assert rows.where(held_out(F.col("id"))).isEmpty()
    flat = calibrate(spark.createDataFrame([(0.5, 1)] * 3, "raw double, label int"), "raw", "label", 0.0, 1.0)
    assert flat(np.array([0.1, 0.9, np.nan])).min() > 0.99
