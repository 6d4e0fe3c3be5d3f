"""The chain against enumeration, its gradient against differences, the tagger by held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strayfinder.llm import language as g
from strayfinder.llm.calibration import held_out

SF = "/root/testdata/sf0.001"


def enumerate_chain(scores, switch):
    steps, states = scores.shape
    out, total = np.zeros_like(scores), 0.0
    for path in itertools.product(range(states), repeat=steps):
        value = np.exp(sum(scores[t, s] for t, s in enumerate(path)) + sum(switch[a, b] for a, b in zip(path, path[1:])))
        total += value
        for t, s in enumerate(path):
            out[t, s] += value
    return out / total, np.log(total)


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_marginals_equal_enumeration(chunk):
    rng = np.random.default_rng(chunk)
    scores, switch = rng.normal(size=(18, 3)) * 3, rng.normal(size=(3, 3))
    bounds = np.array([0, 7, 7, 8, 10, 18])
    want = [enumerate_chain(scores[a:b], switch)[0] for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
    assert np.allclose(g.marginals(scores, switch, bounds, chunk), np.concatenate(want))


def test_long_chains_do_not_underflow():
    rng = np.random.default_rng(0)
    scores, switch = rng.normal(size=(5000, 4)) * 30, np.eye(4) * 20.0
    bounds = np.array([0, 5000])
    assert np.allclose(g.marginals(scores, switch, bounds, 64), g.marginals(scores, switch, bounds, 5000))


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    scores, switch, truth = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))
    value, by_scores, by_switch = g.likelihood(scores, switch, truth)
    paths = sum(sum(scores[i, t, truth[i, t]] for t in range(4)) + sum(switch[truth[i, t], truth[i, t + 1]] for t in range(3)) for i in range(2))
    assert np.isclose(value, paths - sum(enumerate_chain(scores[i], switch)[1] for i in range(2)))
    for array, slope in ((scores, by_scores), (switch, by_switch)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-6
            up = g.likelihood(scores, switch, truth)[0]
            array[at] -= 1e-6
            assert abs((up - value) / 1e-6 - slope[at]) < 1e-4


def test_words_and_features():
    alphabet = g.Alphabet(g.borders())
    texts = ["It's 2 Öl-Fässer, İstanbul!", None, "", "123 ...", "́ क्षि 日本"]
    w = g.words(pa.array(texts, pa.large_string()), alphabet)
    got = [["".join(map(chr, w.codes[s:e])) for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [["it", "s", "öl", "fässer", "İstanbul"], [], [], [], ["क्षि", "日本"]]
    found, bounds, share = g.features(w, g.Lexicon(np.empty(0, np.uint64), np.empty(0, int), 8))
    sizes = (w.ends - w.starts)[w.first]
    want = [1 + sum(max(s + 3 - k, 0) for k in g.NGRAMS) + 2 * sum(s > k for k in g.AFFIXES) for s in sizes]
    assert np.diff(bounds).tolist() == want and np.allclose(share, 1 / np.sqrt(want))
    assert found.min() >= 0 and found.max() == g.HASHED + 8
    # equal endings share features: "running" and "singing"
    pair = g.words(pa.array(["running singing", "qqq"], pa.large_string()), alphabet)
    f, b, _ = g.features(pair, g.Lexicon(np.empty(0, np.uint64), np.empty(0, int), 8))
    sets = [set(f[b[i] : b[i + 1]]) for i in pair.ids]
    assert len(sets[0] & sets[1]) > 8 and len(sets[0] & sets[2]) <= 2


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return g.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def test_held_out_accuracy(spark, tagger):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(held_out(F.col("doc_id")))
    found = g.classify(docs, tagger).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").toPandas()
    assert len(found) > 20 and (found.lang == found.lang_pred).mean() >= 0.95


def test_switched_text_is_cut_where_it_switches(spark, tagger):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [docs.where((F.col("lang") == l) & (F.length("text") > 400)).orderBy("doc_id").first()["text"][:200].rsplit(" ", 1)[0] for l in ("en", "fr", "de")]
    text = " ".join(parts)
    rows = g.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).orderBy("start").collect()
    right = total = 0
    ends = np.cumsum([len(p) + 1 for p in parts])
    for r in rows:
        for at in range(r["start"], r["end"]):
            total += 1
            right += r["lang"] == ("en", "fr", "de")[int(np.searchsorted(ends, at, "right"))]
    assert right / total > 0.9 and sum(r["n_words"] for r in rows) > 60


def test_odd_rows(spark, tagger):
    long = "the of and " * 60_000
    rows = [(1, None, "en"), (2, "", None), (3, "123 !?", "fr"), (None, "the and", "en"), (4, "the and of", "en"), (4, "the and of", "en"),
            (5, long, "en"), (6, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("id", "block", "score", "word", "n"):
        docs = docs.withColumn(name, F.lit(0))
    found = {(r["id"], r["n_words"]): r for r in g.classify(docs, tagger).collect()}
    assert all(found[(i, 0)]["lang_pred"] == "und" and found[(i, 0)]["score"] == 0 for i in (1, 2, 3))
    assert found[(4, 3)]["lang_pred"] == found[(5, 180_000)]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    again = g.identify(docs).collect()
    assert len(again) == len(rows) and {r["lang_pred"] for r in again} <= {"en", "fr", "und"}


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert g.identify(spark.createDataFrame([], schema)).count() == 0
    found = g.identify(spark.createDataFrame([(1, "some words", None), (2, None, None)], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_lexicon_counts_all_rows(spark):
    rows = [(i, "alpha alpha beta", "aa") for i in range(30)] + [(i, "beta gamma", "bb") for i in range(30, 60)]
    taught = spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)
    listed = g.lexicon(taught, ["aa", "bb"], g.borders(), 10)
    w = g.words(pa.array(["alpha beta gamma delta"], pa.large_string()), g.Alphabet(g.borders()))
    own = dict(zip(w.ids.tolist(), range(4)))
    entries = listed.features(w.hashes) - g.HASHED
    by_word = [entries[w.ids[k]] for k in range(4)]
    kinds = len(g.SHARES) + 1
    assert by_word == [kinds - 1, kinds + 1, 2 * kinds - 1, 2 * kinds] and len(own) == 4
