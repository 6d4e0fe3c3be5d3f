"""Detector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayfinder.operators import hbos, iforest, loda, neighbors, ocsvm, pairs, per_feature, spectral
from strayfinder.operators.evaluate import average_precision
from strayfinder.plans.detect import performance_table
from strayfinder.session import sized
from strayfinder.sources.catalog import model_catalog
from workload import fixtures as x
from workload.profile import _BASE_SQL, _BIN_SQL, forest_sql, loda_sql
from workload.registry import query, r, rounded, rs

ALPHAS = (0.1, 0.3, 0.5)

# ------------------------------------------------------------------------------- histograms


@query(
    "det1_hbos_fit",
    f"""WITH {x.LINEITEM}, {x.CELLS}, {_BASE_SQL}, {_BIN_SQL.format(b=30)}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx, CAST(bin AS INTEGER) AS bin, c, n,
       {rs('lo', 'width', 'density')} FROM hist""",
)
def det1_hbos_fit(spark, sf):
    shaped = x.lineitem(spark, sf)
    ranges = sized(hbos.feature_ranges(shaped))
    out = hbos.density(hbos.histogram(shaped, ranges, 30))
    return rounded(out, "lo", "width", "density")


@query(
    "det1_hbos_scores",
    f"""WITH {x.EVENTS}, {x.KEYED_CELLS}, {_BASE_SQL}, {_BIN_SQL.format(b=20)},
alphas AS (SELECT unnest([{', '.join(map(str, ALPHAS))}]::DOUBLE[]) AS alpha),
found AS (
  SELECT b.dataset_id, b.row_id, h.density FROM binned b
  JOIN hist h USING (dataset_id, f_idx, bin))
SELECT dataset_id, row_id, alpha, {r('-sum(log2(density + alpha))')} AS score
FROM found, alphas GROUP BY dataset_id, row_id, alpha""",
)
def det1_hbos_scores(spark, sf):
    shaped = x.events(spark, sf)
    return rounded(hbos.hbos_scores(shaped, hbos.hbos_fit(shaped, 20), ALPHAS), "score")


@query(
    "det2_loda_scores",
    f"""{loda_sql(x.EMBEDDINGS, 15, 50)}
SELECT dataset_id, row_id, {r('-avg(ln(prob))')} AS score
FROM binned JOIN probs USING (dataset_id, cut, bin) GROUP BY dataset_id, row_id""",
)
def det2_loda_scores(spark, sf):
    shaped = x.embeddings(spark, sf)
    return rounded(loda.loda_scores(shaped, loda.loda_fit(shaped, 15, 50)), "score")


def _descent(levels: int = 8) -> str:
    """All rows from the root down, one level a step."""
    steps = ["d0 AS (SELECT s.dataset_id, s.row_id, s.features, m.tree, CAST(1 AS BIGINT) AS node FROM samples s, maps m)"]
    for k in range(levels):
        steps.append(f"""d{k + 1} AS (
  SELECT d.dataset_id, d.row_id, d.features, d.tree,
         CASE WHEN s.f IS NULL THEN d.node WHEN d.features[s.f + 1] > s.cut THEN 2 * d.node + 1 ELSE 2 * d.node END AS node
  FROM d{k} d LEFT JOIN splits s ON s.dataset_id = d.dataset_id AND s.tree = d.tree AND s.node = d.node)""")
    return ",\n".join(steps)


@query(
    "det3_iforest_scores",
    f"""{forest_sql(x.EVENTS, 50, 0.9)},
{_descent()},
scales AS (
  SELECT dataset_id, max(2 * (ln(size - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (size - 1.0::DOUBLE) / size) AS scale
  FROM l0 GROUP BY dataset_id)
SELECT dataset_id, row_id, {r('2.0 ** (-avg(n.path) / any_value(scale))')} AS score
FROM d8 JOIN nodes n USING (dataset_id, tree, node) JOIN scales USING (dataset_id)
GROUP BY dataset_id, row_id""",
)
def det3_iforest_scores(spark, sf):
    shaped = x.events(spark, sf)
    return rounded(iforest.iforest_scores(shaped, iforest.iforest_fit(shaped, 50, 0.9)), "score")


# ------------------------------------------------------------------------------- neighbours

K = 10


def edges_sql(fixture: str, metric: str = "euclidean", k: int = K) -> str:
    if metric == "euclidean":
        distance = "list_distance(a.features, b.features)"
    else:
        distance = (
            "list_sum(list_transform(list_zip(a.features, b.features), lambda p: abs(p[1] - p[2])))"
        )
    return f"""
WITH {fixture},
dist AS (
  SELECT a.dataset_id, a.row_id, b.row_id AS nbr_id, {distance} AS dist
  FROM samples a JOIN samples b ON a.dataset_id = b.dataset_id AND a.row_id <> b.row_id),
edges AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, row_id ORDER BY dist, nbr_id) AS rank
                 FROM dist) WHERE rank <= {k})"""


@query(
    "j7_knn_edges",
    f"""{edges_sql(x.EMBEDDINGS)}
SELECT dataset_id, row_id, nbr_id, {r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM edges""",
)
def j7_knn_edges(spark, sf):
    return rounded(neighbors.knn_edges(x.embeddings(spark, sf), K), "dist")


@query(
    "j7_knn_edges_cells",
    f"""{edges_sql(x.PARTS, k=5)}
SELECT dataset_id, row_id, nbr_id, {r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM edges""",
)
def j7_knn_edges_cells(spark, sf):
    """Many small datasets with small cells, so pivots, routing and merging all take part."""
    return rounded(neighbors.knn_edges(x.parts(spark, sf), 5, cell_rows=32), "dist")


@query(
    "det4_knn_scores",
    f"""{edges_sql(x.EMBEDDINGS)},
scored AS (SELECT dataset_id, row_id, max(dist) AS largest, avg(dist) AS mean, median(dist) AS med
           FROM edges GROUP BY dataset_id, row_id)
SELECT dataset_id, row_id, unnest(['largest', 'mean', 'median']) AS method,
       unnest([{r('largest')}, {r('mean')}, {r('med')}]) AS score FROM scored""",
)
def det4_knn_scores(spark, sf):
    edges = neighbors.knn_edges(x.embeddings(spark, sf), K).persist()
    out = None
    for method in ("largest", "mean", "median"):
        part = neighbors.knn_scores(edges, K, method).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "score")


_LOF_SQL = f"""
kd AS (SELECT dataset_id, row_id, max(dist) AS kd FROM edges GROUP BY dataset_id, row_id),
lrd AS (
  SELECT e.dataset_id, e.row_id, 1 / (avg(greatest(e.dist, kd.kd)) + 1e-10) AS lrd
  FROM edges e JOIN kd ON kd.dataset_id = e.dataset_id AND kd.row_id = e.nbr_id
  GROUP BY e.dataset_id, e.row_id)
SELECT e.dataset_id, e.row_id, {r('avg(n.lrd) / any_value(o.lrd)')} AS score
FROM edges e JOIN lrd n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
JOIN lrd o ON o.dataset_id = e.dataset_id AND o.row_id = e.row_id
GROUP BY e.dataset_id, e.row_id"""


@query("det5_lof_scores", f"{edges_sql(x.EMBEDDINGS)}, {_LOF_SQL}")
def det5_lof_scores(spark, sf):
    edges = neighbors.knn_edges(x.embeddings(spark, sf), K).persist()
    return rounded(neighbors.lof_scores(edges, K), "score")


@query("det5_lof_manhattan", f"{edges_sql(x.EMBEDDINGS, 'manhattan')}, {_LOF_SQL}")
def det5_lof_manhattan(spark, sf):
    edges = neighbors.knn_edges(x.embeddings(spark, sf), K, "manhattan").persist()
    return rounded(neighbors.lof_scores(edges, K), "score")


@query(
    "det6_abod_scores",
    f"""{edges_sql(x.EMBEDDINGS)},
near AS (
  SELECT e.dataset_id, e.row_id, e.rank,
         list_transform(list_zip(n.features, o.features), lambda p: p[1] - p[2]) AS v
  FROM edges e JOIN samples n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
  JOIN samples o ON o.dataset_id = e.dataset_id AND o.row_id = e.row_id)
SELECT a.dataset_id, a.row_id,
       {r('-var_pop(list_dot_product(a.v, b.v) / (list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))')} AS score
FROM near a JOIN near b ON a.dataset_id = b.dataset_id AND a.row_id = b.row_id AND a.rank < b.rank
GROUP BY a.dataset_id, a.row_id""",
)
def det6_abod_scores(spark, sf):
    shaped = x.embeddings(spark, sf)
    return rounded(neighbors.abod_scores(neighbors.knn_edges(shaped, K), shaped, K), "score")


@query(
    "det7_cof_scores",
    f"""{edges_sql(x.EMBEDDINGS)},
path AS (
  SELECT dataset_id, row_id, nbr_id, rank FROM edges
  UNION ALL SELECT dataset_id, row_id, row_id, 0 FROM samples),
cost AS (
  SELECT j.dataset_id, j.row_id, j.rank, min(d.dist) AS cost
  FROM path j JOIN path m ON m.dataset_id = j.dataset_id AND m.row_id = j.row_id AND m.rank < j.rank
  JOIN dist d ON d.dataset_id = j.dataset_id AND d.row_id = j.nbr_id AND d.nbr_id = m.nbr_id
  GROUP BY j.dataset_id, j.row_id, j.rank),
chain AS (
  SELECT dataset_id, row_id, sum(2.0 * ({K} + 1 - rank) / ({K} * ({K} + 1.0)) * cost) AS chain
  FROM cost GROUP BY dataset_id, row_id)
SELECT e.dataset_id, e.row_id, {r('any_value(o.chain) / avg(n.chain)')} AS score
FROM edges e JOIN chain n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
JOIN chain o ON o.dataset_id = e.dataset_id AND o.row_id = e.row_id
GROUP BY e.dataset_id, e.row_id""",
)
def det7_cof_scores(spark, sf):
    shaped = x.embeddings(spark, sf)
    edges = neighbors.knn_edges(shaped, K).persist()
    return rounded(neighbors.cof_scores(edges, shaped, K), "score")


# Rows with even ids are fitted, the others are new to the detectors.
_UNSEEN = f"""{edges_sql(x.EMBEDDINGS.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 2 = 0)'))},
fresh AS (
  SELECT 'embeddings' AS dataset_id, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings WHERE vec_id % 2 <> 0),
new_dist AS (
  SELECT a.dataset_id, a.row_id, b.row_id AS nbr_id, list_distance(a.features, b.features) AS dist
  FROM fresh a JOIN samples b ON a.dataset_id = b.dataset_id),
new_edges AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, row_id ORDER BY dist, nbr_id) AS rank
                 FROM new_dist) WHERE rank <= {K})"""


def _halves(spark, sf):
    shaped = x.embeddings(spark, sf)
    fitted = neighbors.fit_neighbors(shaped.where(F.col("row_id") % 2 == 0), K)
    return fitted, shaped.where(F.col("row_id") % 2 != 0)


@query(
    "j7_knn_join_unseen",
    f"""{_UNSEEN}
SELECT dataset_id, row_id, nbr_id, {r('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM new_edges""",
)
def j7_knn_join_unseen(spark, sf):
    fitted, new = _halves(spark, sf)
    return rounded(fitted.query(new), "dist")


@query(
    "det4_knn_unseen",
    f"""{_UNSEEN}
SELECT dataset_id, row_id, {r('avg(dist)')} AS score FROM new_edges GROUP BY dataset_id, row_id""",
)
def det4_knn_unseen(spark, sf):
    fitted, new = _halves(spark, sf)
    return rounded(fitted.score("KNN", new, method="mean"), "score")


@query(
    "det5_lof_unseen",
    f"""{_UNSEEN},
kd AS (SELECT dataset_id, row_id, max(dist) AS kd FROM edges GROUP BY dataset_id, row_id),
lrd AS (
  SELECT e.dataset_id, e.row_id, 1 / (avg(greatest(e.dist, kd.kd)) + 1e-10) AS lrd
  FROM edges e JOIN kd ON kd.dataset_id = e.dataset_id AND kd.row_id = e.nbr_id
  GROUP BY e.dataset_id, e.row_id)
SELECT e.dataset_id, e.row_id, {r('avg(n.lrd) * (avg(greatest(e.dist, kd.kd)) + 1e-10)')} AS score
FROM new_edges e JOIN lrd n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
JOIN kd ON kd.dataset_id = e.dataset_id AND kd.row_id = e.nbr_id
GROUP BY e.dataset_id, e.row_id""",
)
def det5_lof_unseen(spark, sf):
    fitted, new = _halves(spark, sf)
    return rounded(fitted.score("LOF", new), "score")


@query(
    "det6_abod_unseen",
    f"""{_UNSEEN},
near AS (
  SELECT e.dataset_id, e.row_id, e.rank,
         list_transform(list_zip(n.features, o.features), lambda p: p[1] - p[2]) AS v
  FROM new_edges e JOIN samples n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
  JOIN fresh o ON o.dataset_id = e.dataset_id AND o.row_id = e.row_id)
SELECT a.dataset_id, a.row_id,
       {r('-var_pop(list_dot_product(a.v, b.v) / (list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))')} AS score
FROM near a JOIN near b ON a.dataset_id = b.dataset_id AND a.row_id = b.row_id AND a.rank < b.rank
GROUP BY a.dataset_id, a.row_id""",
)
def det6_abod_unseen(spark, sf):
    fitted, new = _halves(spark, sf)
    return rounded(fitted.score("ABOD", new), "score")


@query(
    "det7_cof_unseen",
    f"""{_UNSEEN},
path AS (
  SELECT dataset_id, row_id, nbr_id, rank FROM edges
  UNION ALL SELECT dataset_id, row_id, row_id, 0 FROM samples),
cost AS (
  SELECT j.dataset_id, j.row_id, j.rank, min(d.dist) AS cost
  FROM path j JOIN path m ON m.dataset_id = j.dataset_id AND m.row_id = j.row_id AND m.rank < j.rank
  JOIN dist d ON d.dataset_id = j.dataset_id AND d.row_id = j.nbr_id AND d.nbr_id = m.nbr_id
  GROUP BY j.dataset_id, j.row_id, j.rank),
chain AS (
  SELECT dataset_id, row_id, sum(2.0 * ({K} + 1 - rank) / ({K} * ({K} + 1.0)) * cost) AS chain
  FROM cost GROUP BY dataset_id, row_id),
new_cost AS (
  SELECT j.dataset_id, j.row_id, j.rank, least(any_value(j.dist), min(d.dist)) AS cost
  FROM new_edges j LEFT JOIN new_edges m ON m.dataset_id = j.dataset_id AND m.row_id = j.row_id AND m.rank < j.rank
  LEFT JOIN dist d ON d.dataset_id = j.dataset_id AND d.row_id = j.nbr_id AND d.nbr_id = m.nbr_id
  GROUP BY j.dataset_id, j.row_id, j.rank),
new_chain AS (
  SELECT dataset_id, row_id, sum(2.0 * ({K} + 1 - rank) / ({K} * ({K} + 1.0)) * cost) AS chain
  FROM new_cost GROUP BY dataset_id, row_id)
SELECT e.dataset_id, e.row_id, {r('any_value(o.chain) / avg(n.chain)')} AS score
FROM new_edges e JOIN chain n ON n.dataset_id = e.dataset_id AND n.row_id = e.nbr_id
JOIN new_chain o ON o.dataset_id = e.dataset_id AND o.row_id = e.row_id
GROUP BY e.dataset_id, e.row_id""",
)
def det7_cof_unseen(spark, sf):
    fitted, new = _halves(spark, sf)
    return rounded(fitted.score("COF", new), "score")


@query("det8_ocsvm_scores")
def det8_ocsvm_scores(spark, sf):
    shaped = x.embeddings(spark, sf)
    return rounded(ocsvm.ocsvm_scores(shaped, ocsvm.ocsvm_fit(shaped, 0.6, "rbf"), "rbf"), "score")


@query("det9_pca_scores")
def det9_pca_scores(spark, sf):
    shaped = x.embeddings(spark, sf)
    base = sized(per_feature.feature_base(shaped))
    found = spectral.eigen(pairs.cross_products(shaped, base), base, scaled=True)
    return rounded(spectral.pca_scores(shaped, found), "score")


# ------------------------------------------------------------------------------- evaluation

_AP_SQL = """
steps AS (
  SELECT {keys}, score, count(*) AS c, sum(label) AS tp FROM labelled GROUP BY {keys}, score),
running AS (
  SELECT *, sum(c) OVER w AS cum_c, sum(tp) OVER w AS cum_tp FROM steps
  WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))
SELECT {keys}, {ap} AS ap{extra} FROM running GROUP BY {keys}"""


@query(
    "agg4_w4_average_precision",
    f"""WITH {x.DOCUMENTS},
labelled AS (SELECT dataset_id, 0 AS model_id, features[1] / features[2] AS score, label
             FROM samples WHERE label IS NOT NULL),
{_AP_SQL.format(keys='dataset_id, model_id', ap=r('sum(tp * cum_tp / cum_c) / nullif(sum(tp), 0)'),
                extra=', CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(tp) AS BIGINT) AS n_positive')}""",
)
def agg4_w4_average_precision(spark, sf):
    """Average word length as the outlier score of toxic documents."""
    scored = x.documents(spark, sf).where("label IS NOT NULL").select(
        "dataset_id",
        F.lit(0).alias("model_id"),
        (F.col("features")[0] / F.col("features")[1]).alias("score"),
        "label",
    )
    return rounded(average_precision(scored), "ap")


@query(
    "rec10_performance_hbos",
    f"""WITH {x.DOCUMENTS}, {x.KEYED_CELLS},
ranges AS (
  SELECT dataset_id, f_idx, count(*) AS n,
         CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM cells GROUP BY dataset_id, f_idx),
placed AS (
  SELECT *, least(CAST(floor((value - lo) * (b / (hi - lo))) AS INTEGER), CAST(b AS INTEGER) - 1) AS i0,
         (hi - lo) / b AS st
  FROM cells JOIN ranges USING (dataset_id, f_idx),
       (SELECT unnest([5, 10, 20, 30, 40, 50, 75, 100]::DOUBLE[]) AS b)),
binned AS (
  SELECT *, CASE WHEN value < i0 * st + lo THEN i0 - 1
                 WHEN value >= (i0 + 1) * st + lo AND i0 < b - 1 THEN i0 + 1 ELSE i0 END AS bin
  FROM placed),
hist AS (
  SELECT dataset_id, b, f_idx, bin, count(*) / (any_value(n) * any_value(st)) AS density
  FROM binned GROUP BY dataset_id, b, f_idx, bin),
scores AS (
  SELECT dataset_id, row_id, b, alpha, round(-sum(log2(density + alpha)), 9) AS score
  FROM binned JOIN hist USING (dataset_id, b, f_idx, bin),
       (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS alpha)
  GROUP BY dataset_id, row_id, b, alpha),
labelled AS (
  SELECT dataset_id,
         CAST(255 + 5 * (list_position([5, 10, 20, 30, 40, 50, 75, 100]::DOUBLE[], b) - 1)
              + list_position([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[], alpha) - 1 - 36 AS INTEGER) AS model_id,
         score, label
  FROM scores JOIN (SELECT dataset_id, row_id, label FROM samples) USING (dataset_id, row_id)
  WHERE label IS NOT NULL),
{_AP_SQL.format(keys='dataset_id, model_id', ap=r('sum(tp * cum_tp / cum_c) / nullif(sum(tp), 0)'), extra='')}""",
)
def rec10_performance_hbos(spark, sf):
    """All 40 histogram models of the catalogue on the labelled documents."""
    models = model_catalog(spark).where("family = 'HBOS'")
    return rounded(performance_table(x.documents(spark, sf), models, digits=9), "ap")


_NEIGHBOR_AP = f"""{{scores}},
labelled AS (
  SELECT dataset_id, model_id, round(score, 9) AS score, label
  FROM scores JOIN (SELECT dataset_id, row_id, label FROM samples) USING (dataset_id, row_id)
  WHERE label IS NOT NULL),
{_AP_SQL.format(keys='dataset_id, model_id', ap=r('sum(tp * cum_tp / cum_c) / nullif(sum(tp), 0)'), extra='')}"""

_GRID = "[1, 5, 10, 15, 20, 25, 50, 60, 70, 80, 90, 100]"
_KNN_AP = _NEIGHBOR_AP.format(scores=f"""{edges_sql(x.DOCUMENTS, k=100)},
scores AS (
  SELECT dataset_id, row_id, CAST(147 + 12 * list_position(['largest', 'mean', 'median'], m) - 12 + i AS INTEGER) AS model_id,
         CASE m WHEN 'largest' THEN max(dist) WHEN 'mean' THEN avg(dist) ELSE median(dist) END AS score
  FROM edges, (SELECT unnest({_GRID}) AS k, unnest(range(12)) AS i), (SELECT unnest(['largest', 'mean', 'median']) AS m)
  WHERE rank <= k GROUP BY dataset_id, row_id, m, i)""")


@query("rec10_performance_knn", _KNN_AP)
def rec10_performance_knn(spark, sf):
    """All 36 distance models of the catalogue on the labelled documents."""
    models = model_catalog(spark).where("family = 'KNN'")
    return rounded(performance_table(x.documents(spark, sf), models, digits=9), "ap")


@query("rec10_performance_all")
def rec10_performance_all(spark, sf):
    """The whole performance table: all 302 models of the catalogue on the labelled documents."""
    return performance_table(x.documents(spark, sf), model_catalog(spark))


# One setting of every family, by name.
MIXED = (
    "LODA(n_bins=5, n_random_cuts=100)",
    "LODA(n_bins=5, n_random_cuts=20)",
    "ABOD(n_neighbors=5)",
    "IForest(max_features=0.7, n_estimators=50)",
    "KNN(method=mean, n_neighbors=10)",
    "LOF(metric=manhattan, n_neighbors=10)",
    "HBOS(alpha=0.2, n_bins=10)",
    "OCSVM(kernel=sigmoid, nu=0.6)",
    "COF(n_neighbors=10)",
)


@query("rec10_performance_mixed")
def rec10_performance_mixed(spark, sf):
    """One model of every family on the labelled documents."""
    models = model_catalog(spark).where(F.col("name").isin(*MIXED))
    return performance_table(x.documents(spark, sf), models)
