import numpy as np
import pytest

from strayfinder import session
from strayfinder.operators import hbos, iforest, loda, neighbor_tables, neighbors, ocsvm
from strayfinder.plans.detect import performance_table, run_models
from strayfinder.sources.catalog import model_catalog


def scores(df):
    return {(r.dataset_id, r.row_id): r.score for r in df.collect()}


def cloud(seed=0, n=150, p=3):
    x = np.random.default_rng(seed).normal(size=(n, p))
    x[:4] += 6
    return x


def brute(x, k, metric="euclidean"):
    """{row: [(neighbour, distance)]} with ties to the smaller id."""
    d = x[:, None, :] - x[None, :, :]
    d = abs(d).sum(2) if metric == "manhattan" else np.sqrt((d**2).sum(2))
    out = {}
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        out[i] = [(j, d[i, j]) for j in order]
    return out


def edge_map(edges, name):
    out = {}
    for r in edges.where(f"dataset_id = '{name}'").orderBy("rank").collect():
        out.setdefault(r.row_id, []).append((r.nbr_id, r.dist))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_knn_equals_brute_force(make_samples, metric, cell_rows):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 4, size=(160, 2)).astype(float)  # many ties and copies
    copies = np.vstack([np.full((60, 2), 1.5), rng.normal(size=(80, 2))])
    sets = {"cloud": cloud(), "grid": grid, "copies": copies, "tiny": cloud(n=3)}
    edges = neighbors.knn_edges(make_samples(sets), 5, metric, cell_rows=cell_rows)
    for name, x in sets.items():
        got, want = edge_map(edges, name), brute(x, 5, metric)
        assert got.keys() == want.keys()
        for i in want:
            assert [j for j, _ in got[i]] == [j for j, _ in want[i]], (name, i)
            assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_neighbours_of_unseen_rows(make_samples, metric, cell_rows):
    rng = np.random.default_rng(2)
    sets = {"cloud": cloud(1), "grid": rng.integers(0, 4, size=(160, 2)).astype(float), "tiny": cloud(n=3)}
    fresh = {"cloud": cloud(7, n=40), "grid": rng.integers(0, 5, size=(50, 2)).astype(float), "tiny": cloud(9, n=5)}
    model = neighbors.fit_neighbors(make_samples(sets), 5, metric, cell_rows=cell_rows)
    edges = model.query(make_samples(fresh))
    for name, x in sets.items():
        got, q = edge_map(edges, name), fresh[name]
        d = np.abs(q[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
        for i in range(len(q)):
            order = np.lexsort((np.arange(len(x)), d[i]))[:5]
            assert [j for j, _ in got[i]] == order.tolist(), (name, i)
            assert [v for _, v in got[i]] == pytest.approx(d[i][order], abs=1e-12)


def test_unseen_scores_follow_the_definitions(spark, make_samples, tmp_path):
    x, q, k = cloud(3, n=80), cloud(8, n=30), 6
    model = neighbors.fit_neighbors(make_samples({"a": x}), k, cell_rows=16)
    new = make_samples({"a": q})
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    near = [np.lexsort((np.arange(80), row))[:k] for row in d]
    own = brute(x, k)
    kd = np.array([own[i][-1][1] for i in range(80)])
    lrd = np.array([1 / (np.mean([max(v, kd[j]) for j, v in own[i]]) + 1e-10) for i in range(80)])

    def chain(point, ids):
        path = [point, *x[ids]]
        return sum(2 * (k + 1 - j) / (k * (k + 1)) * min(np.linalg.norm(path[j] - p) for p in path[:j]) for j in range(1, k + 1))

    chains = np.array([chain(x[i], [j for j, _ in own[i]]) for i in range(80)])
    want = {"KNN": [], "LOF": [], "ABOD": [], "COF": []}
    for i in range(30):
        n, v = near[i], d[i][near[i]]
        want["KNN"].append(v.max())
        want["LOF"].append(lrd[n].mean() * (np.maximum(v, kd[n]).mean() + 1e-10))
        ways = x[n] - q[i]
        angles = [ways[a] @ ways[b] / (ways[a] @ ways[a]) / (ways[b] @ ways[b]) for a in range(k) for b in range(a)]
        want["ABOD"].append(-np.var(angles))
        want["COF"].append(chain(q[i], n) / chains[n].mean())
    for family, values in want.items():
        got = scores(model.score(family, new))
        assert [got["a", i] for i in range(30)] == pytest.approx(values, rel=1e-9), family
    model.save(str(tmp_path / "model"))
    kept = neighbors.load_neighbors(spark, str(tmp_path / "model"))
    assert ("LOF", k) in kept.states and ("COF", k) in kept.states
    got = scores(kept.score("LOF", new))
    assert [got["a", i] for i in range(30)] == pytest.approx(want["LOF"], rel=1e-9)
    with pytest.raises(ValueError):
        kept.query(new, k + 1)


def test_rounds_open_few_cells(make_samples):
    """64 dimensions in 40 groups: ids routed stay far below rows times cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * 4
    x = np.vstack([c + 0.3 * rng.normal(size=(100, 64)) for c in centres])
    log = []
    model = neighbors.fit_neighbors(make_samples({"a": x}), 5, cell_rows=100, log=log)
    cells = model.cells.cells.count()
    sent = sum(n for _, n in log)
    assert cells > 25 and len(log) > 1 and sent < 0.35 * len(x) * cells
    got, want = edge_map(model.edges, "a"), brute(x, 5)
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in range(0, 4000, 37))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_vectors_travel_once_per_shard(make_samples, monkeypatch, metric):
    """32 dimensions without groups: every cell is open, but a vector goes to shards, not to cells."""
    x, sent = np.random.default_rng(5).normal(size=(600, 32)), []
    search = neighbors._grouped_search

    def spied(queries, *rest):
        sent.append(queries.count())
        return search(queries, *rest)

    monkeypatch.setattr(neighbors, "_grouped_search", spied)
    monkeypatch.setattr(neighbors, "SHARD_ROWS", 250)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    edges = neighbors.knn_edges(make_samples({"a": x}), 5, metric, cell_rows=30)
    assert sum(sent) <= 3 * 4 * len(x)
    got, want = edge_map(edges, "a"), brute(x, 5, metric)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


@pytest.mark.parametrize("n", [600, 1800])
def test_vectors_sent_per_row_do_not_grow(make_samples, monkeypatch, n):
    """Without groups every cell is open; a row's vector still travels as often as in a table a third as large."""
    x, sent = np.random.default_rng(8).normal(size=(n, 32)), []
    spread = neighbors.spread

    def spied(df, *keys):
        sent.append(df.count())
        return spread(df, *keys)

    monkeypatch.setattr(neighbors, "spread", spied)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 30)
    edges = neighbors.knn_edges(make_samples({"a": x}), 5, cell_rows=30)
    assert sum(sent) <= 18 * n
    got, want = edge_map(edges, "a"), brute(x, 5)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_features_travel_as_floats_only_if_exact(make_samples):
    x = np.random.default_rng(9).integers(0, 50, size=(200, 4)) / 8
    for data, kind in ((x, "array<float>"), (np.vstack([x, [[0.1, 0, 0, 0]]]), "array<double>")):
        model = neighbors.fit_neighbors(make_samples({"a": data}), 5, cell_rows=40)
        assert model.cells.placed.schema["features"].dataType.simpleString() == kind
        got, want = edge_map(model.edges, "a"), brute(data, 5)
        assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("bounded", [False, True])
def test_nearest_on_hard_scales(metric, bounded):
    """Ties, an offset that single precision cannot resolve, and a row far from all others."""
    rng = np.random.default_rng(6)
    for x in (rng.integers(0, 3, size=(300, 4)) * 1.0, 1e8 + rng.normal(size=(300, 3)), np.vstack([rng.normal(size=(299, 3)), np.full((1, 3), 1e25)])):
        ids, want = np.arange(300), brute(x, 7, metric)
        limit = np.array([want[i][-1][1] for i in range(300)]) if bounded else np.full(300, np.inf)
        at, nbr, _ = neighbors.nearest(ids, x, ids, x, 7, metric, limit)
        assert all(nbr[at == i].tolist() == [j for j, _ in want[i]] for i in range(300))


def test_knn_far_from_zero(make_samples):
    x = cloud(3) * 1e-3 + 1e6
    edges = neighbors.knn_edges(make_samples({"far": x}), 4)
    got, want = edge_map(edges, "far"), brute(x, 4)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {
        i: [j for j, _ in v] for i, v in want.items()
    }


def test_neighbour_detectors(make_samples):
    x, k = cloud(2, n=60), 6
    df = make_samples({"a": x})
    edges = neighbors.knn_edges(df, k).persist()
    near = brute(x, k)
    dist = {i: np.array([d for _, d in v]) for i, v in near.items()}
    ids = {i: [j for j, _ in v] for i, v in near.items()}
    got = scores(neighbors.knn_scores(edges, k, "median"))
    assert got["a", 0] == pytest.approx(np.median(dist[0]))

    lrd = {
        i: 1 / (np.mean([max(d, dist[j].max()) for j, d in near[i]]) + 1e-10) for i in near
    }
    lof = {i: np.mean([lrd[j] for j in ids[i]]) / lrd[i] for i in near}
    for hot in (neighbors.HOT_ROWS, 3):
        got = scores(neighbors.lof_scores(edges, k, hot_rows=hot))
        assert [got["a", i] for i in near] == pytest.approx([lof[i] for i in near])

    def chain(i):
        path = x[[i, *ids[i]]]
        cost = [np.sqrt(((path[:j] - path[j]) ** 2).sum(1)).min() for j in range(1, k + 1)]
        return sum(2 * (k + 1 - j) / (k * (k + 1)) * cost[j - 1] for j in range(1, k + 1))

    cof = {i: chain(i) / np.mean([chain(j) for j in ids[i]]) for i in near}
    got = scores(neighbors.cof_scores(edges, df, k))
    assert [got["a", i] for i in near] == pytest.approx([cof[i] for i in near])

    def angles(i):
        v = x[ids[i]] - x[i]
        w = [
            v[a] @ v[b] / ((v[a] @ v[a]) * (v[b] @ v[b]))
            for a in range(k) for b in range(a + 1, k)
        ]
        return -np.var(w)

    got = scores(neighbors.abod_scores(edges, df, k, hot_rows=3))
    assert [got["a", i] for i in near] == pytest.approx([angles(i) for i in near])


def test_copies_do_not_break_detectors(make_samples):
    x = np.vstack([np.ones((40, 2)), np.random.default_rng(0).normal(size=(10, 2)) * 5])
    df = make_samples({"a": x})
    edges = neighbors.knn_edges(df, 5).persist()
    assert edges.groupBy("row_id").count().where("count <> 5").count() == 0
    lof = scores(neighbors.lof_scores(edges, 5))
    assert all(np.isfinite(v) for v in lof.values()) and lof["a", 0] == pytest.approx(1.0)
    assert len(scores(neighbors.abod_scores(edges, df, 5))) == 50
    assert all(np.isfinite(v) for v in scores(neighbors.cof_scores(edges, df, 5)).values())


def test_hbos_out_of_range(make_samples, spark):
    x = np.column_stack([np.arange(100.0), np.arange(100.0) % 7])
    model = hbos.hbos_fit(make_samples({"a": x}), 5)
    new = make_samples({"a": [[50, 3], [99 + 9, 3], [99 + 11, 3], [-500, 3]]})
    got = scores(hbos.hbos_scores(new, model))
    d = np.histogram(x[:, 1], 5, density=True)[0]
    first = np.histogram(x[:, 0], 5, density=True)[0]
    at3 = np.log2(d[2] + 0.1)
    want = [-(np.log2(first[2] + 0.1) + at3), -(np.log2(first[4] + 0.1) + at3)]
    assert [got["a", 0], got["a", 1]] == pytest.approx(want)
    assert got["a", 2] == pytest.approx(-(np.log2(first.min() + 0.1) + at3))
    assert got["a", 3] == got["a", 2]


def test_hbos_scores_a_stream(make_samples, spark, tmp_path):
    df = make_samples({"a": cloud()})
    model = hbos.hbos_fit(df, 10)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scored = hbos.hbos_scores(stream, model)
    assert scored.isStreaming
    run = scored.writeStream.format("memory").queryName("hbos_stream").start()
    run.processAllAvailable()
    run.stop()
    assert scores(spark.table("hbos_stream")) == scores(hbos.hbos_scores(df, model))


def test_loda(make_samples):
    w = loda.cut_weights(10, 40, seed=3)
    assert ((w != 0).sum(axis=0) == 3).all()
    assert (loda.cut_weights(10, 5, seed=3) == w[:, :5]).all()
    assert not (loda.cut_weights(10, 5, seed=4) == w[:, :5]).all()
    x = cloud(n=200)
    df = make_samples({"a": x, "b": cloud(1, n=30)})
    model = loda.loda_fit(df, 10, 25)
    got = scores(loda.loda_scores(df, model))
    z = x @ loda.cut_weights(3, 25)
    want = np.zeros(len(x))
    for c in range(25):
        counts, edges = np.histogram(z[:, c], 10)
        p = (counts + 1e-12) / (counts + 1e-12).sum()
        want -= np.log(p[np.clip(np.searchsorted(edges, z[:, c], "right") - 1, 0, 9)])
    assert [got["a", i] for i in range(200)] == pytest.approx(want / 25)


def test_iforest(make_samples):
    x = cloud(n=400)
    df = make_samples({"a": x}, partitions=1)
    model = iforest.iforest_fit(df, 30, seed=5)
    trees = model.collect()
    assert len(trees) == 30 and {t.sample_size for t in trees} == {256}
    for t in trees:
        child = np.array(t.child)
        leaves = (child < 0).sum()
        assert leaves <= 256 and max(t.depth) <= 8 and len(child) == 2 * leaves - 1
    got = scores(iforest.iforest_scores(df, model))
    again = make_samples({"a": x}, partitions=6)
    assert scores(iforest.iforest_scores(again, iforest.iforest_fit(again, 30, seed=5))) == got
    assert 0 < min(got.values()) and max(got.values()) <= 1
    ranked = sorted(got, key=got.get, reverse=True)[:4]
    assert {i for _, i in ranked} == {0, 1, 2, 3}
    shapes = iforest.tree_shapes(model).collect()
    assert all(s.IForest_fi_mean == pytest.approx(1 / 3) for s in shapes)
    assert all(1 / 3 <= s.IForest_fi_max <= 1 for s in shapes)


def test_subsamples_of_a_large_dataset_are_full(make_samples, monkeypatch):
    monkeypatch.setattr(iforest, "SUBSAMPLE", 16)
    df = make_samples({"a": np.random.default_rng(0).normal(size=(5000, 2))})
    got = iforest.tree_samples(df, 5).groupBy("tree").count().collect()
    assert len(got) == 5 and {r["count"] for r in got} == {16}


def test_large_parameter_tables_meet_rows_in_a_shuffle(make_samples, monkeypatch):
    df = make_samples({"a": cloud(), "b": cloud(1, n=70)})
    forest = iforest.iforest_fit(df, 8, seed=1).persist()
    cuts = loda.loda_fit(df, 5, 10).persist()
    want = scores(iforest.iforest_scores(df, forest)), scores(loda.loda_scores(df, cuts))
    monkeypatch.setattr(session, "SMALL_BYTES", 0)
    monkeypatch.setattr(session, "BLOCK_ROWS", 20)
    got = scores(iforest.iforest_scores(df, forest)), scores(loda.loda_scores(df, cuts))
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def one_class_reference(x, nu, kernel="rbf", steps=4000):
    """Small dual solver: accelerated projected gradient on the capped simplex."""
    if kernel == "rbf":
        k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1])
    else:
        k = x @ x.T
    cap, top = 1 / (nu * len(x)), np.linalg.norm(k, 2)
    a = before = np.full(len(x), 1 / len(x))
    for t in range(steps):
        y = a + t / (t + 3) * (a - before)
        g = y - k @ y / top
        lo, hi = g.min() - cap - 1, g.max()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(g - mid, 0, cap).sum() > 1 else (lo, mid)
        before, a = a, np.clip(g - lo, 0, cap)
    return a @ k @ a, -(k @ a)


def rank_correlation(a, b):
    return np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1]


def test_smallest_norm_of_mixtures():
    rng = np.random.default_rng(0)
    for n, size in ((2, 3), (6, 4), (12, 30)):
        atoms = rng.normal(size=(n, size)) + 1.0
        shares = np.zeros(n)
        shares[0] = 1.0
        for k in range(2, n + 1):
            shares[:k] = ocsvm.smallest_norm(atoms[:k], shares[:k])
        for _ in range(200):  # major cycles on the atoms at hand
            point = shares @ atoms
            worst = int((atoms @ point).argmin())
            if point @ point - atoms[worst] @ point < 1e-10:
                break
            order = np.append(np.delete(np.arange(n), worst), worst)
            shares[order] = ocsvm.smallest_norm(atoms[order], shares[order])
        point = shares @ atoms
        assert shares.min() >= 0 and shares.sum() == pytest.approx(1)
        assert point @ point - (atoms @ point).min() < 1e-8


def test_ocsvm_reaches_the_dual_solution(make_samples):
    x = cloud(4, n=80, p=2) + 3
    df = make_samples({"a": x, "b": cloud(6, n=50, p=2)})  # the origin is among the means of b
    for kernel in ("rbf", "linear"):
        log = []
        model = ocsvm.ocsvm_fit_all(df, [0.2, 0.5], kernel, gap=1e-5, log=log)
        row = model.where("dataset_id = 'a'").first()
        w = np.reshape(row.w, (2, -1))
        got = {(r.nu, r.row_id): r.score for r in ocsvm.ocsvm_scores_all(df, model, kernel).where("dataset_id = 'a'").collect()}
        assert max(row.gap) <= 1e-5 and len(log) < 60
        for j, nu in enumerate((0.2, 0.5)):
            norm, want = one_class_reference(x, nu, kernel)
            ours = np.array([got[nu, i] for i in range(80)])
            assert w[j] @ w[j] == pytest.approx(norm, rel=1e-3)
            # scores below the margin stay apart from each other, those on it are equal up to the gap
            assert np.abs((ours - row.rho[j]) - want).max() <= 0.02 * np.sqrt(norm) * np.sqrt((x * x).sum(1).max() if kernel == "linear" else 1)
            projections = np.sort(row.rho[j] - ours)
            assert row.rho[j] == pytest.approx(projections[int(np.ceil(nu * 80)) - 1])


@pytest.mark.parametrize("kernel", ["rbf", "linear"])
def test_ocsvm_ranks_like_the_dual_with_landmarks(make_samples, kernel):
    x = np.random.default_rng(11).normal(size=(1500, 3)) * [1.0, 2.0, 0.5] + ([2.0, 1.0, 1.0] if kernel == "linear" else 0.0)
    df = make_samples({"a": x})
    model = ocsvm.ocsvm_fit(df, 0.3, kernel)
    if kernel == "rbf":
        assert len(model.first().landmarks) < 3 * 1500
    got = scores(ocsvm.ocsvm_scores(df, model, kernel))
    ours = np.array([got["a", i] for i in range(1500)])
    assert rank_correlation(ours, one_class_reference(x, 0.3, kernel, 1500)[1]) > 0.99
    assert abs((ours > 0).mean() - 0.3) < 0.01  # nu is the share of rows outside


def test_ocsvm_passes_without_a_job_each(spark, make_samples):
    x = np.random.default_rng(3).normal(size=(300, 3)) * 40  # rows far apart: the solution takes many passes
    df, log = make_samples({"a": x, "b": x[:90] / 40}), []
    spark.sparkContext.setJobGroup("ocsvm", "passes")
    ocsvm.ocsvm_fit_all(df, [0.3, 0.6, 0.9], "rbf", log=log)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ocsvm"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(log) > 10 and log[-1] <= 1e-3
    assert jobs < 40 + len(log)  # three or more a pass before


@pytest.mark.parametrize("numbers", [10**6, 1])
@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_ocsvm_of_large_datasets_equals_that_of_small_ones(make_samples, monkeypatch, kernel, numbers):
    rng = np.random.default_rng(5)
    df = make_samples({"a": rng.normal(size=(400, 3)) + 1, "b": rng.normal(size=(60, 2)), "c": rng.normal(size=(130, 4)) - 2})
    nus, logs = [0.2, 0.5, 0.8], ([], [])
    want = {r.dataset_id: r for r in ocsvm.ocsvm_fit_all(df, nus, kernel, log=logs[0]).collect()}
    monkeypatch.setattr(ocsvm, "LOCAL_NUMBERS", 0)
    monkeypatch.setattr(ocsvm, "DRIVER_NUMBERS", numbers)  # 1: one dataset at a time, tallies added by tasks
    monkeypatch.setattr(ocsvm, "PACKED_ROWS", 50)
    got = {r.dataset_id: r for r in ocsvm.ocsvm_fit_all(df, nus, kernel, log=logs[1]).collect()}
    assert got.keys() == want.keys() and len(logs[0]) == len(logs[1])
    for name, row in want.items():
        assert max(row.gap) <= ocsvm.GAP
        assert np.array(got[name].w) == pytest.approx(np.array(row.w), rel=1e-6, abs=1e-9)
        assert got[name].rho == pytest.approx(row.rho, rel=1e-6, abs=1e-9)


def test_only_labelled_rows_are_scored(make_samples, monkeypatch):
    scored = []
    plain = hbos.hbos_scores

    def counted(rows, *args, **options):
        scored.append(rows.count())
        return plain(rows, *args, **options)

    x = cloud(7, n=80)
    df = make_samples({"a": x}, {"a": np.r_[np.ones(4), np.zeros(76)].astype(int)})
    models = model_catalog(df.sparkSession).where("name = 'HBOS(alpha=0.1, n_bins=10)'")
    some = df.selectExpr("dataset_id", "row_id", "features", "if(row_id % 4 = 0, label, null) AS label")
    scores_of = {r.row_id: r.score for r in run_models(df, models).collect()}
    monkeypatch.setattr(hbos, "hbos_scores", counted)
    found = performance_table(some, models).collect()
    assert scored == [20]
    ranked = sorted(((scores_of[i], i) for i in range(0, 80, 4)), reverse=True)
    assert ranked[0][1] == 0 and found[0].ap == pytest.approx(1.0)  # fitted on all rows: the outlier comes first


def test_all_settings_equal_single_ones(make_samples):
    x = cloud(5, n=70)
    x[10:14] = x[10]  # copies
    df = make_samples({"a": x, "tiny": cloud(n=4)})
    edges = neighbors.knn_edges(df, 9).persist()
    ks = {1: 3, 2: 5, 3: 9}
    many = {
        "lof": neighbors.lof_scores_all(edges, ks), "abod": neighbors.abod_scores_all(edges, df, ks),
        "cof": neighbors.cof_scores_all(edges, df, ks),
        "knn": neighbors.knn_scores_all(edges, {m: (k, ("largest", "mean", "median")[m - 1]) for m, k in ks.items()}),
    }
    for m, k in ks.items():
        one = {
            "lof": neighbors.lof_scores(edges, k), "abod": neighbors.abod_scores(edges, df, k),
            "cof": neighbors.cof_scores(edges, df, k), "knn": neighbors.knn_scores(edges, k, ("largest", "mean", "median")[m - 1]),
        }
        for family, table in many.items():
            got, want = scores(table.where(f"model_id = {m}")), scores(one[family])
            assert got.keys() == want.keys()
            values = [[np.nan if t[i] is None else t[i] for i in want] for t in (got, want)]
            assert values[0] == pytest.approx(values[1], rel=1e-9, nan_ok=True), (family, k)


def test_scores_from_neighbour_lists_equal_joins(make_samples, monkeypatch):
    x = cloud(5, n=70)
    x[10:24] = x[10]  # more copies than neighbours
    df = make_samples({"a": x, "tiny": cloud(n=4), "b": cloud(8, n=40, p=2)})
    asked = df.where("row_id % 3 = 0")
    edges = neighbors.knn_edges(df, 9).persist()
    monkeypatch.setattr(neighbor_tables, "PACKED_ROWS", 16)
    lists = neighbor_tables.pack(edges, df, asked)
    vectors = neighbor_tables.features(lists, df)
    ks = {1: 3, 2: 5, 3: 9}
    knn = {m: (k, ("largest", "mean", "median")[m - 1]) for m, k in ks.items()}
    pairs = [
        ([neighbor_tables.knn_scores_all(lists, knn)], neighbors.knn_scores_all(edges, knn)),
        (neighbor_tables.lof_scores_all(lists, ks), neighbors.lof_scores_all(edges, ks)),
        ([neighbor_tables.abod_scores_all(lists, vectors, ks)], neighbors.abod_scores_all(edges, df, ks)),
        ([neighbor_tables.cof_scores_all(lists, vectors, ks)], neighbors.cof_scores_all(edges, df, ks)),
    ]
    # tables of one k at a time, as for many rows
    monkeypatch.setattr(neighbor_tables, "SMALL_BYTES", 8 * lists.rows)
    parts = neighbor_tables.lof_scores_all(lists, ks)
    assert len(parts) == 3
    pairs.append((parts, neighbors.lof_scores_all(edges, ks)))
    for ours, theirs in pairs:
        got = {(r.dataset_id, r.row_id, r.model_id): r.score for part in ours for r in part.collect()}
        want = {(r.dataset_id, r.row_id, r.model_id): r.score for r in theirs.where("row_id % 3 = 0").collect()}
        assert got.keys() == want.keys() and len(got) == 3 * (24 + 2 + 14)
        values = [[np.nan if t[i] is None else t[i] for i in want] for t in (got, want)]
        assert values[0] == pytest.approx(values[1], rel=1e-9, nan_ok=True)


def test_neighbour_lists_need_single_ids_and_small_tables(make_samples, monkeypatch):
    df = make_samples({"a": cloud(n=30)})
    edges = neighbors.knn_edges(df, 3).persist()
    assert neighbor_tables.pack(edges, df.unionByName(df.limit(1))) is None
    assert neighbor_tables.pack(edges, df.selectExpr("dataset_id", "nullif(row_id, 3) AS row_id", "features")) is None
    lists = neighbor_tables.pack(edges, df)
    monkeypatch.setattr(neighbor_tables, "SMALL_BYTES", 100)
    assert neighbor_tables.pack(edges, df) is None and neighbor_tables.features(lists, df) is None
    assert neighbor_tables.lof_scores_all(lists, {1: 3}) is None


def test_every_family_without_tables_equals_that_with(make_samples, monkeypatch):
    labels = {"a": np.r_[np.ones(6), np.zeros(54)].astype(int)}
    df = make_samples({"a": cloud(5, n=60)}, labels)
    names = [f"{f}(n_neighbors=5)" for f in ("ABOD", "COF")] + [f"LOF(metric={m}, n_neighbors=5)" for m in ("manhattan", "euclidean")]
    models = model_catalog(df.sparkSession)
    models = models.where(models.name.isin(*names, "KNN(method=mean, n_neighbors=5)"))
    want = {r.model_id: r.ap for r in performance_table(df, models, digits=9).collect()}
    monkeypatch.setattr(neighbor_tables, "lof_scores_all", lambda *args: None)  # as where tables are too large
    monkeypatch.setattr(neighbor_tables, "features", lambda *args: None)
    assert {r.model_id: r.ap for r in performance_table(df, models, digits=9).collect()} == pytest.approx(want)
    monkeypatch.setattr(neighbor_tables, "pack", lambda *args: None)
    assert {r.model_id: r.ap for r in performance_table(df, models, digits=9).collect()} == pytest.approx(want) and len(want) == 5


def test_neighbour_scores_send_no_edges(spark, make_samples, monkeypatch):
    df = make_samples({"a": cloud(5, n=60)}, {"a": np.r_[np.ones(6), np.zeros(54)].astype(int)})
    models = model_catalog(spark).where("name = 'LOF(metric=euclidean, n_neighbors=10)'")
    monkeypatch.setattr(neighbors, "lookup", lambda *args: pytest.fail("edges are joined to their neighbours"))
    assert performance_table(df, models).count() == 1


def test_every_family_runs(make_samples):
    names = (
        "LODA(n_bins=5, n_random_cuts=10)", "ABOD(n_neighbors=5)",
        "IForest(max_features=0.5, n_estimators=10)", "KNN(method=largest, n_neighbors=5)",
        "LOF(metric=minkowski, n_neighbors=5)", "LOF(metric=manhattan, n_neighbors=5)",
        "HBOS(alpha=0.1, n_bins=5)", "OCSVM(kernel=linear, nu=0.5)", "COF(n_neighbors=5)",
    )
    x = cloud(5, n=60)
    labels = {"a": np.r_[np.ones(4), np.zeros(56)].astype(int)}
    df = make_samples({"a": x}, labels)
    catalog = model_catalog(df.sparkSession)
    models = catalog.where(catalog.name.isin(*names))
    assert run_models(df, models).count() == 9 * 60
    table = {r.model_id: r.ap for r in performance_table(df, models).collect()}
    assert len(table) == 9 and all(0 <= v <= 1 for v in table.values())
    by_name = {r.name: table[r.model_id] for r in models.collect()}
    assert by_name["KNN(method=largest, n_neighbors=5)"] > 0.9


def test_catalog(spark):
    rows = model_catalog(spark).orderBy("model_id").collect()
    assert [r.model_id for r in rows] == list(range(302))
    counts = {}
    for r in rows:
        counts[r.family] = counts.get(r.family, 0) + 1
    assert counts == {
        "LODA": 54, "ABOD": 12, "IForest": 81, "KNN": 36, "LOF": 36, "HBOS": 40, "OCSVM": 36,
        "COF": 7,
    }
    assert rows[0].params == {"n_bins": "5", "n_random_cuts": "10"}
    assert rows[301].params == {"n_neighbors": "50"}


def test_neighbour_families_share_one_evaluation(spark):
    """KNN, LOF, ABOD and COF of the catalogue are scored from the same joins; every model is scored once."""
    from strayfinder.plans.detect import _evaluations

    of = {row.model_id: row.family for row in model_catalog(spark).collect()}
    groups = _evaluations(model_catalog(spark))
    assert sorted(m for g in groups for m in g) == sorted(of)
    assert [{of[m] for m in g} for g in groups if "KNN" in {of[m] for m in g}] == [{"KNN", "LOF", "ABOD", "COF"}]


@pytest.mark.parametrize("cell_rows", [4096, 30])
def test_edges_of_asked_rows(make_samples, cell_rows):
    """Copies, one cell or many: the asked rows' edges are those of the whole join, and no others are made."""
    x = np.vstack([cloud(2, 120), np.zeros((12, 3))])
    df = make_samples({"a": x})
    asked = df.where("row_id % 3 = 0").select("dataset_id", "row_id")
    got = edge_map(neighbors.knn_edges(df, 4, cell_rows=cell_rows, asked=asked), "a")
    whole = edge_map(neighbors.knn_edges(df, 4, cell_rows=cell_rows), "a")
    assert got == {i: v for i, v in whole.items() if i % 3 == 0}
