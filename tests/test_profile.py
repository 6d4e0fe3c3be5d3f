import numpy as np
import pandas as pd
import pytest

from strayfinder.functions.scalar import SUMMARY_PARTS, summaries
from strayfinder.functions.special import f_tail
from strayfinder.operators import pairs, per_feature, pooled
from strayfinder.plans.profile import META_NAMES, profile, statistics
from strayfinder.operators.loda import range_fold
from strayfinder.operators.spectral import first_row_fold
from strayfinder.session import batches_by_rows, fold_together, gathered, sized
from strayfinder.sources.datasets import validate


def values(long):
    return {(r.dataset_id, r.name): r.value for r in long.collect()}


def data(seed=0, n=120, p=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 10, 0.1, 3][:p] + [0, 5, -2, 1][:p]
    x[:, 0] = np.round(x[:, 0], 1)
    x[:5] += 20
    return x


def six(v):
    v = np.asarray(v, float)
    m, s = v.mean(), v.std()
    if s <= 1e-12 * max(1, abs(m)):
        return [v.min(), v.max(), m, s, None, None]
    z = (v - m) / s
    return [v.min(), v.max(), m, s, (z**3).mean(), (z**4).mean() - 3]


def expected(x):
    """The deterministic meta-features by numpy."""
    n, p = x.shape
    flat = x.ravel()
    q = np.percentile(x, [0.01, 0.25, 0.75, 0.99])
    iqr, med, mean, std = q[2] - q[1], np.median(x), x.mean(), x.std()
    shifted = np.sort(flat - min(flat.min(), 0) + 1e-7)
    i = np.arange(1, len(flat) + 1)
    out = {
        "n_samples": n, "n_features": p, "sample_mean": mean, "sample_median": med,
        "sample_var": x.var(), "sample_min": flat.min(), "sample_max": flat.max(),
        "sample_std": std, "q1": q[0], "q25": q[1], "q75": q[2], "q99": q[3], "iqr": iqr,
        "normalized_mean": mean / flat.max(), "normalized_median": med / flat.max(),
        "sample_range": np.ptp(flat),
        "sample_gini": ((2 * i - len(flat) - 1) * shifted).sum() / (len(flat) * shifted.sum()),
        "med_abs_dev": np.median(abs(flat - med)), "avg_abs_dev": abs(flat - mean).mean(),
        "quant_coeff_disp": iqr / (q[2] + q[1]), "coeff_var": x.var() / mean,
    }
    for tag, lo, hi in (
        ("15iqr", q[1] - 1.5 * iqr, q[2] + 1.5 * iqr), ("3iqr", q[1] - 3 * iqr, q[2] + 3 * iqr),
        ("1_99", q[0], q[3]), ("3std", mean - 3 * std, mean + 3 * std),
    ):
        outside = (x < lo) | (x > hi)
        out[f"percent_outliers_{tag}"] = outside.sum() / n
        out[f"has_outliers_{tag}"] = int(outside.any())
    centred = x - x.mean(axis=0)
    blocks = {f"moment_{k}": (centred**k).mean(axis=0) for k in range(5, 11)}
    z = centred / x.std(axis=0)
    blocks["skewness"], blocks["kurtosis"] = (z**3).mean(axis=0), (z**4).mean(axis=0) - 3
    counts = [np.unique(c, return_counts=True)[1] for c in x.T]
    blocks["sparsity"] = [len(c) / n for c in counts]
    blocks["entropy"] = [-(c / n * np.log(c / n)).sum() / n for c in counts]
    low = np.tril_indices(p, -1)
    blocks["correlation"], blocks["covariance"] = np.corrcoef(x.T)[low], np.cov(x.T)[low]
    hist = np.array([np.histogram(c, 10, density=True)[0] for c in x.T])
    blocks["HBOS_mean"], blocks["HBOS_max"], blocks["HBOS_min"] = (
        hist.mean(axis=1), hist.max(axis=1), hist.min(axis=1),
    )
    for b, v in blocks.items():
        for part, value in zip(("min", "max", "mean", "std", "skewness", "kurtosis"), six(v)):
            out[f"{b}_{part}"] = value
    sv = np.linalg.svd(z, compute_uv=False)
    for k in range(3):
        out[f"pca_sv_{k + 1}"] = sv[k]
        out[f"pca_expl_ratio_{k + 1}"] = sv[k] ** 2 / (sv**2).sum()
    return out


def test_names():
    assert len(META_NAMES) == len(set(META_NAMES)) == 200
    assert META_NAMES[119] == "first_pca_std" and META_NAMES[146] == "IForest_n_leaves_min"


def test_statistics_against_numpy(make_samples):
    sets = {"a": data(1), "b": data(2, n=60), "c": data(3, n=30, p=3)}
    got = values(statistics(make_samples(sets)))
    for name, x in sets.items():
        for feature, want in expected(x).items():
            have = got[name, feature]
            if want is None:
                assert have is None, feature
            else:
                assert have == pytest.approx(want, rel=1e-7, abs=1e-9), (name, feature)


def test_profile_has_200_rows_and_ignores_partitioning(make_samples):
    sets = {"a": data(1, n=300), "b": data(2, n=40)}
    first = values(profile(make_samples(sets, partitions=1)))
    other = values(profile(make_samples(sets, partitions=7)))
    assert len(first) == 400
    for key, value in first.items():
        if value is None:
            assert other[key] is None, key
        else:
            assert other[key] == pytest.approx(value, rel=1e-6, abs=1e-7), key


def test_first_row_scores(make_samples):
    x = data(5, n=50)
    got = values(profile(make_samples({"a": x})))
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    t = c @ vt[:3].T
    t *= np.sign(t[abs(t).argmax(axis=0), range(3)])
    want = six(t[0])
    assert got["a", "first_pca_std"] == pytest.approx(want[3], rel=1e-6)
    assert got["a", "first_pca_skewness"] == pytest.approx(want[4], rel=1e-5)


def test_range_partitioned_order_statistics_equal_the_window(make_samples):
    df = make_samples({"big": data(1, n=400), "small": data(2, n=9)})
    plain = {r.dataset_id: r for r in pooled.pooled(df).collect()}
    ranged = {r.dataset_id: r for r in pooled.pooled(df, window_rows=50).collect()}
    for name, row in plain.items():
        assert list(ranged[name])[1:] == pytest.approx(list(row)[1:], rel=1e-12)


def test_merged_base_equals_a_scan(make_samples):
    df = make_samples({"a": data(1) + 1e6, "b": data(2)})
    scan = {r.dataset_id: r for r in pooled.pooled_base(df).collect()}
    merged = {r.dataset_id: r for r in pooled.merged_base(per_feature.feature_base(df)).collect()}
    for name, row in scan.items():
        for column in row.asDict():
            if column != "dataset_id":
                assert merged[name][column] == pytest.approx(row[column], rel=1e-9), column


def test_constant_columns_and_small_datasets(make_samples):
    x = np.column_stack([np.ones(20), np.arange(20.0), np.arange(20.0) ** 2])
    got = values(statistics(make_samples({"flat": x, "few": data(1, n=5), "thin": data(1, p=2)})))
    assert got["flat", "correlation_min"] == 0.0
    assert got["flat", "skewness_max"] is not None and got["flat", "skewness_min"] is not None
    assert got["few", "normality_p_min"] is None and got["few", "is_normal_5_max"] == 0.0
    assert got["thin", "pca_sv_1"] is None
    zero = values(statistics(make_samples({"zero": np.zeros((10, 3))})))
    for ratio in ("normalized_mean", "coeff_var", "quant_coeff_disp"):
        assert zero["zero", ratio] is None


def test_published_example(make_samples):
    df = make_samples({"a": [[1], [2], [7], [11], [3]]})
    base = per_feature.feature_base(df).first()
    assert base.skewness == pytest.approx(0.651698, abs=1e-6)
    assert base.kurtosis == pytest.approx(-1.118138, abs=1e-6)
    assert pooled.pooled(df).first().q1 == pytest.approx(1.0004)


def test_gini_bounds_and_shift(make_samples):
    x = np.abs(data(1, n=50))
    got = {r.dataset_id: r.sample_gini for r in pooled.pooled(
        make_samples({"a": x, "minus": x - x.max() - 1})).collect()}
    assert 0 <= got["a"] < 1 and 0 <= got["minus"] < 1


def test_normality_rate_under_the_null(make_samples):
    rng = np.random.default_rng(0)
    df = make_samples({"n": rng.normal(size=(100, 400))})
    p = [r.normality_p for r in per_feature.normality(per_feature.feature_base(df)).collect()]
    assert 0.01 < np.mean(np.array(p) < 0.05) < 0.11


def test_f_tail():
    # two-sided t probabilities: t = 2 at 10 and at 1e6 degrees of freedom
    assert f_tail([4.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-7)
    assert f_tail([4.0], [1e6])[0] == pytest.approx(0.0455003, abs=1e-6)
    low, high = f_tail([3.0, 3.0], [19_998.0, 20_002.0])
    assert low == pytest.approx(high, rel=1e-4)
    assert f_tail([0.0, 1e9], [8.0, 8.0]) == pytest.approx([1.0, 0.0], abs=1e-12)


def test_flatten_diagonally(spark):
    n = 4
    m = np.arange(n * n).reshape(n, n)
    rows = [(int(i), int(j), int(m[i, j]), n) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "i int, j int, v int, n int")
    got = [r.v for r in pairs.flatten_diagonally(df).orderBy("position").collect()]
    want = [v for d in range(n - 1, -n, -1) for v in np.diagonal(m, -d)]
    assert got == [int(v) for v in want]
    assert set(got[: (n * n - n) // 2]) == set(m[np.tril_indices(n, -1)].tolist())
    assert pairs.flatten_diagonally(df, diagonals=[n - 1]).count() == n


def test_validation(spark, make_samples):
    good = make_samples({"a": data(1)})
    assert validate(good, 4) is good
    with pytest.raises(ValueError):
        validate(good, 200)
    for bad in ([1.0, None], [1.0, float("nan")], [float("-inf"), 1.0], [1.0], []):
        df = spark.createDataFrame(
            [("a", [1.0, 2.0]), ("a", bad)], "dataset_id string, features array<double>"
        )
        with pytest.raises(ValueError):
            validate(df)
        with pytest.raises(ValueError):
            per_feature.validate_base(sized(per_feature.feature_base(df)))


def test_summaries_merge_scales(spark):
    """Moments of values from 1e-200 to 1e300, merged from several scales, without a window."""
    rng = np.random.default_rng(0)
    sets = {
        "plain": rng.normal(size=500).tolist(), "wide": (10.0 ** rng.uniform(-200, 200, 60)).tolist(),
        "mixed": [0.0, 0.0, 1.0, 1e30, -2e30, 5.0, None], "huge": [1e300, 2e300, -1.5e300, 1.7e300],
        "zero": [0.0] * 4, "one": [3.0], "same": [2.5] * 5, "none": [None, None],
    }
    rows = [(name, v) for name, values in sets.items() for v in values]
    out = summaries(spark.createDataFrame(rows, "dataset_id string, b double").repartition(5), ["b"])
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {(r.dataset_id, r.name): r.value for r in out.collect()}
    assert len(got) == 6 * len(sets)
    for name, values in sets.items():
        x = np.array([v for v in values if v is not None], dtype=np.longdouble)
        parts = [got[name, f"b_{p}"] for p in SUMMARY_PARTS]
        if not len(x):
            assert parts == [None] * 6
            continue
        d = x - x.mean()
        v = (d * d).mean()
        assert parts[:4] == pytest.approx([float(x.min()), float(x.max()), float(x.mean()), float(np.sqrt(v))], rel=1e-12)
        if v == 0:
            assert parts[4:] == [None, None]
        else:
            assert parts[4:] == pytest.approx([float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3)], rel=1e-9)


def test_gathering_few_datasets_holds_little():
    """A task holds about 100,000 values of few datasets, and more only of many interleaved ones."""

    def pieces(datasets):
        rows = (pd.DataFrame({"dataset_id": [f"d{i % datasets}" for i in range(10_000)], "features": [np.zeros(3)] * 10_000}) for _ in range(30))
        return [len(p) for p in gathered(rows)]

    assert max(pieces(6)) <= 40_000 and sum(pieces(6)) == 300_000
    assert max(pieces(5_000)) == 300_000


def test_profile_reads_the_rows_four_times(spark, make_samples):
    """For value counts, products and LODA ranges, first rows and LODA counts, and the forest."""
    rows = make_samples({"a": data(0), "b": data(1)})
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    profile(rows.mapInPandas(counting, rows.schema)).collect()
    assert 0 < read.value <= 4 * 240


def test_feature_base_from_value_counts_equals_scans(spark):
    rows = [("a", [1.0, 2.0]), ("a", [1.0, None]), ("a", [4.0, -3.5]), ("b", [7.0, 7.0]), ("b", []), ("b", None)]
    df = spark.createDataFrame(rows, "dataset_id string, features array<double>")
    keys = ["dataset_id", "f_idx"]
    scans, counted = (
        per_feature.feature_base(df, c).toPandas().sort_values(keys).reset_index(drop=True)
        for c in (None, pooled.value_counts(df, outer=True))
    )
    pd.testing.assert_frame_equal(scans, counted, check_dtype=False)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_folds_together_keep_large_ids(spark, monkeypatch, small):
    monkeypatch.setattr("strayfinder.session.SMALL_BYTES", small)
    first = 2**62 + 1
    rows = spark.createDataFrame(
        [("a", first + i, [float(i), 1.0, i * i / 7]) for i in (1, 0, 2)], "dataset_id string, row_id bigint, features array<double>"
    )
    side = spark.createDataFrame(
        [("a", k, [float(k == j) for j in range(3)], [0.0] * 3) for k in range(3)],
        "dataset_id string, component int, vector array<double>, mean array<double>",
    )
    found, reached = fold_together(rows.coalesce(1), [first_row_fold(side), range_fold(cuts=4)])
    assert [(r.component, r.row_id, r.score) for r in found.orderBy("component").collect()] == [
        (0, first, 0.0), (1, first, 1.0), (2, first, 0.0)
    ]
    assert reached.count() == 4 and reached.where("lo <= hi").count() == 4


def test_batches_by_rows_of_narrow_rows_only(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    with batches_by_rows(spark, 4):
        assert spark.conf.get(limit) == str(2**31 - 1)
    with batches_by_rows(spark, 100_000):
        assert spark.conf.get(limit) == before
    assert spark.conf.get(limit) == before
