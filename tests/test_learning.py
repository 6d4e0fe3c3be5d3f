import numpy as np
import pytest
from pyspark.sql import functions as F

from strayfinder.operators import transform
from strayfinder.operators.evaluate import average_precision, mean_ndcg, ndcg
from strayfinder.operators.ranking import best_item, nth_model, top_models
from strayfinder.plans import factorize
from strayfinder.plans.history import should_stop, stopping_history
from strayfinder.plans.profile import META_WIDTH
from strayfinder.plans.recommend import (
    fit_recommender,
    load_recommender,
    save_recommender,
    similar_datasets,
)
from strayfinder.sources.catalog import model_catalog


def test_average_precision(spark):
    rng = np.random.default_rng(0)
    score, label = rng.integers(0, 12, 80) / 4, rng.integers(0, 2, 80)
    rows = [("d", 1, float(s), int(y)) for s, y in zip(score, label)]
    rows += [("d", 2, float(-i), int(i < 5)) for i in range(20)] + [("d", 3, 1.0, 0)]
    df = spark.createDataFrame(rows, "dataset_id string, model_id int, score double, label int")
    want, tp_before = 0.0, 0
    for s in sorted(set(score), reverse=True):
        taken = score >= s
        tp = label[taken].sum()
        want += (tp - tp_before) / label.sum() * tp / taken.sum()
        tp_before = tp
    for window_rows in (None, 3):
        got = {r.model_id: r.ap for r in average_precision(df, window_rows=window_rows).collect()}
        assert got[1] == pytest.approx(want) and got[2] == 1.0 and got[3] is None


def test_ndcg(spark):
    rows = [("perfect", i, float(i), float(i)) for i in range(5)]
    rows += [("zero", i, 0.0, float(i)) for i in range(5)]
    rows += [("tied", i, float(i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "dataset_id string, model_id int, truth double, score double")
    got = {r.dataset_id: r.ndcg for r in ndcg(df).collect()}
    d = 1 / np.log2(np.arange(2, 6))
    assert got["perfect"] == pytest.approx(1) and got["zero"] == 0
    assert got["tied"] == pytest.approx(1.5 * d.sum() / (np.arange(4)[::-1] * d).sum())


def test_top_models(spark):
    rows = [("d", 0, 1.0), ("d", 1, 2.0), ("d", 2, 2.0), ("d", 3, None), ("d", 4, float("nan"))]
    df = spark.createDataFrame(rows, "dataset_id string, model_id int, score double")
    assert [r.model_id for r in top_models(df, 9).orderBy("rank").collect()] == [2, 1, 0]
    assert nth_model(df, 2).first().model_id == 1
    assert df.groupBy("dataset_id").agg(best_item().alias("b")).first().b == 1


def test_transforms(spark):
    rows = [("a", 0, 1.0), ("b", 0, 3.0), ("c", 0, None), ("a", 1, 5.0), ("b", 1, 5.0),
            ("c", 1, float("nan")), ("a", 2, None)]
    df = spark.createDataFrame(rows, "dataset_id string, idx int, value double")

    def table(out):
        return {(r.dataset_id, r.idx): r.value for r in out.collect()}

    filled = table(transform.mean_fill(df))
    assert filled["c", 0] == 2.0 and filled["c", 1] == 5.0 and filled["a", 2] is None
    scaled = table(transform.min_max_apply(df, transform.min_max_fit(df)))
    assert scaled["b", 0] == 1.0 and scaled["b", 1] == 0.0 and scaled["c", 0] is None
    assert table(transform.zero_filled(df))["c", 1] == 0.0
    unit = table(transform.standard_apply(df, transform.standard_fit(df)))
    assert unit["a", 0] == -1.0 and unit["a", 1] == 0.0


def test_split(spark):
    ids = spark.range(100).select(F.concat(F.lit("d"), "id").alias("dataset_id"))
    a = {r.dataset_id: r.split for r in transform.split_datasets(ids, seed=1).collect()}
    b = {r.dataset_id: r.split for r in transform.split_datasets(ids.repartition(9), seed=1).collect()}
    c = {r.dataset_id: r.split for r in transform.split_datasets(ids, seed=2).collect()}
    assert a == b != c and list(a.values()).count("train") == 85


def factors(spark, n=6, m=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    u, v, r = rng.normal(size=(n, k)), rng.normal(size=(m, k)), rng.random((n, m))
    names = [f"d{i}" for i in range(n)]
    u_df = spark.createDataFrame(
        [(a, b.tolist()) for a, b in zip(names, u)], "dataset_id string, u array<double>"
    )
    r_df = spark.createDataFrame(
        [(a, b.tolist()) for a, b in zip(names, r)], "dataset_id string, ratings array<double>"
    )
    return u, v, r, u_df, r_df


def objective(u, v, r):
    s = u @ v.T
    total = 0.0
    for h in range(len(u)):
        for i in range(len(v)):
            phi = 1.5 + sum(
                1 / (1 + np.exp(-(s[h, j] - s[h, i]))) for j in range(len(v)) if j != i
            )
            total += (10 ** r[h, i] - 1) / np.log(phi)
    return total


def test_gradient_against_finite_differences(spark):
    u, v, r, u_df, r_df = factors(spark)
    table = factorize.factor_table(spark, v, range(len(v)))
    got = sum(x.term for x in factorize.objective(u_df, r_df, table).collect())
    assert got == pytest.approx(objective(u, v, r))
    step = factorize.gradient_step(u_df, r_df, v, 1e-3).persist()
    moved = {x.dataset_id: np.array(x.vec) for x in step.where("dataset_id IS NOT NULL").collect()}
    for h in range(len(u)):
        for k in range(u.shape[1]):
            up, down = u.copy(), u.copy()
            up[h, k] += 1e-6
            down[h, k] -= 1e-6
            slope = (objective(up, v, r) - objective(down, v, r)) / 2e-6
            # the step climbs the objective
            assert moved[f"d{h}"][k] - u[h, k] == pytest.approx(1e-3 * slope, rel=1e-4, abs=1e-9)
    assert factorize.summed_gradient(step).count() == v.size


def test_rates_and_stopping(spark):
    rates = factorize.cyclic_rates(18, 0.1, 0.9, 8)
    assert rates[:2] == pytest.approx([0.1, 0.1 + 0.8 / 7])
    assert rates[7:9] == [0.9, 0.9] and rates[15:17] == [0.1, 0.1]

    def stops(scores):
        rows = [("r", i + 1, x) for i, x in enumerate(scores)]
        return should_stop(spark.createDataFrame(rows, "run string, iteration int, valid_ndcg double"), 0.1, 0.9, 8)

    assert not stops([0.5])
    assert not stops([0.5, 0.5, 0.5, 0.5, 0.5])
    assert stops([0.5] * 6)
    assert not stops([0.5] * 4 + [0.6] + [0.6] * 4)


def toy(spark, n=40, m=6, width=META_WIDTH, seed=0):
    """Model quality that depends on the meta-features."""
    rng = np.random.default_rng(seed)
    meta = rng.random((n, width))
    latent = meta[:, :2] - 0.5
    quality = 1 / (1 + np.exp(-6 * latent @ rng.normal(size=(2, m))))
    names = [f"d{i:03}" for i in range(n)]
    long = [(a, i, float(x)) for a, row in zip(names, meta) for i, x in enumerate(row)]
    ap = [(a, j, float(q)) for a, row in zip(names, quality) for j, q in enumerate(row)]
    return (
        spark.createDataFrame(long, "dataset_id string, idx int, value double").persist(),
        spark.createDataFrame(ap, "dataset_id string, model_id int, ap double").persist(),
    )


@pytest.fixture(scope="module")
def fitted(spark):
    meta, ap = toy(spark)
    recommender = fit_recommender(
        meta, ap, model_catalog(spark), seeds=(0, 2), factors=3, iterations=3, trees=10, depth=5,
        min_rate=0.1, max_rate=0.9, n_steps=8, batch_fraction=0.5,
    )
    return meta, ap, recommender


def test_training_goes_on_where_it_was_cut_off(spark, tmp_path, monkeypatch):
    from strayfinder.plans.profile import meta_vectors

    meta, ap = toy(spark, n=30, m=5, width=8)
    vectors = meta_vectors(meta)
    early = F.col("dataset_id") < "d020"
    tables = vectors.where(early), ap.where(early), vectors.where(~early), ap.where(~early)
    options = {"factors": 2, "trees": 2, "depth": 2, "min_rate": 0.1, "max_rate": 0.9, "n_steps": 8, "batch_fraction": 0.5}
    whole = factorize.train(*tables, iterations=4, **options)
    folder, calls, real = str(tmp_path / "run"), [], factorize.summed_gradient

    def lost(step):
        calls.append(1)
        if len(calls) == 6:  # the second batch of the third iteration
            raise RuntimeError("driver lost")
        return real(step)

    monkeypatch.setattr(factorize, "summed_gradient", lost)
    with pytest.raises(RuntimeError):
        factorize.train(*tables, iterations=4, folder=folder, **options)
    resumed = factorize.train(*tables, iterations=4, folder=folder, **options)
    assert len(calls) == 6 + 4  # two iterations of two batches were left
    assert [r["iteration"] for r in resumed.history] == [1, 2, 3, 4]
    for a, b in zip(whole.history, resumed.history):
        assert a == pytest.approx(b, rel=1e-6)
    for a, b in zip(*(m.model_factors.orderBy("model_id").collect() for m in (whole, resumed))):
        assert a.v == pytest.approx(b.v, rel=1e-6)
    again = factorize.train(*tables, iterations=4, folder=folder, **options)
    assert len(calls) == 10 and again.history == resumed.history
    longer = factorize.train(*tables, iterations=5, folder=folder, **options)
    assert len(calls) == 12 and longer.history[:4] == resumed.history
    rows = [("r", r["iteration"], r["valid_ndcg"]) for r in longer.history]
    checked = stopping_history(spark.createDataFrame(rows, "run string, iteration int, valid_ndcg double"), 0.1, 0.9, 8)
    assert [r.rate for r in checked.orderBy("iteration").collect()] == pytest.approx([r["rate"] for r in longer.history])


def test_training_beats_random_factors(spark, fitted):
    meta, ap, recommender = fitted
    truth = ap.withColumnRenamed("ap", "truth")
    trained = mean_ndcg(
        recommender.scores(meta).join(truth, ["dataset_id", "model_id"])
    ).first().mean_ndcg
    rng = np.random.default_rng(0)
    random = []
    for _ in range(3):
        u = spark.createDataFrame(
            [(f"d{i:03}", rng.normal(size=3).tolist()) for i in range(40)],
            "dataset_id string, u array<double>",
        )
        v = factorize.factor_table(spark, rng.normal(size=(6, 3)), range(6))
        s = factorize.score_models(u, v).join(truth, ["dataset_id", "model_id"])
        random.append(mean_ndcg(s).first().mean_ndcg)
    assert trained > max(random)
    for model in recommender.trained:
        assert len(model.history) == 3
        assert all(0 <= h["valid_ndcg"] <= 1 for h in model.history)


def test_recommendation_contract_and_artifacts(spark, fitted, tmp_path):
    meta, _, recommender = fitted
    want = recommender.recommend_profiled(meta, 5).orderBy("dataset_id", "rank").collect()
    assert len(want) == 40 * 5
    for i in range(0, len(want), 5):
        part = want[i : i + 5]
        assert [p["rank"] for p in part] == [1, 2, 3, 4, 5]
        assert len({p.name for p in part}) == 5
        assert [p.score for p in part] == sorted((p.score for p in part), reverse=True)
    save_recommender(str(tmp_path / "saved"), recommender)
    loaded = load_recommender(spark, str(tmp_path / "saved"), 2)
    again = loaded.recommend_profiled(meta, 5).orderBy("dataset_id", "rank").collect()
    assert [(r.model_id, r["rank"]) for r in again] == [(r.model_id, r["rank"]) for r in want]
    assert recommender.scores(meta, impute="mean").count() == 40 * 6


def test_recommend_new_data(spark, make_samples):
    """Ask for 100 models for new data, get 100 distinct ones in order."""
    rng = np.random.default_rng(0)
    sets = {}
    for i in range(8):
        x = rng.normal(size=(60, 3)) * (1 + i)
        x[: 3 + i] += 5 * (1 + i)
        sets[f"d{i}"] = x
    from strayfinder.plans.profile import profile

    meta = profile(make_samples(sets)).persist()
    ap = spark.createDataFrame(
        [(d, m, float(q)) for d in sets for m, q in enumerate(rng.random(302))],
        "dataset_id string, model_id int, ap double",
    )
    recommender = fit_recommender(
        meta, ap, model_catalog(spark), seeds=(0,), fraction=0.75, factors=2, iterations=1,
        trees=3, depth=3, batch_fraction=1.0,
    )
    x = rng.normal(size=(200, 3))
    got = recommender.recommend(make_samples({"new": x}), 100).orderBy("rank").collect()
    assert len(got) == 100 and len({r.name for r in got}) == 100
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_similar_datasets(spark):
    rng = np.random.default_rng(1)
    x = rng.random((30, 4))
    df = spark.createDataFrame(
        [(f"d{i}", r.tolist()) for i, r in enumerate(x)], "dataset_id string, features array<double>"
    )
    for r in similar_datasets(df).collect():
        i = int(r.dataset_id[1:])
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert r.similar_id == f"d{d.argmin()}" and r.distance == pytest.approx(d.min())


def test_rating_vectors_of_complete_and_partial_datasets(spark):
    rows = [("a", 2, 0.2), ("a", 0, 0.0), ("a", 1, None), ("b", 1, 0.5), ("c", 0, 0.7), ("c", 1, 0.8), ("c", 5, 0.9)]
    table = spark.createDataFrame(rows, "dataset_id string, model_id int, ap double")
    for ids in ([0, 1, 2], [2, 0, 1]):
        got = {r.dataset_id: r.ratings for r in factorize.rating_vectors(table, ids).collect()}
        want = {d: [dict((m, x) for e, m, x in rows if e == d).get(i) for i in ids] for d in "abc"}
        assert got == want


def test_supplier_training_reads_line_items_once(spark):
    """What training gets is written; its steps do not go back to the line items."""
    from workload.learning import _supplier_training

    for table in _supplier_training(spark, "/root/testdata/sf0.001"):
        assert "FileScan" not in table._jdf.queryExecution().executedPlan().toString()
