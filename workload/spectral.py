"""Spectral queries on three features, where eigenpairs have a closed form in SQL."""

from __future__ import annotations

from strayfinder.operators import pairs, per_feature, spectral
from strayfinder.session import sized
from workload import fixtures as x
from workload.registry import query, r, rounded


def eigen_sql(scaled: bool) -> str:
    """Eigenpairs of the 3 x 3 matrices of events: (dataset_id, component, l, vector).

    Eigenvalues by the trigonometric solution of the cubic, vectors as cross products of two rows of
    the shifted matrix, of the three the longest, with a positive largest weight.
    """
    a = {f"{i}{j}": f"covar_pop(x{i}, x{j})" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))}
    if scaled:
        a = {k: f"{v} / (stddev_pop(x{k[0]}) * stddev_pop(x{k[1]}))" for k, v in a.items()}
    entries = ", ".join(f"{v} AS a{k}" for k, v in a.items())
    rows = ("[a11 - l, a12, a13]", "[a12, a22 - l, a23]", "[a13, a23, a33 - l]")

    def cross(u: str, v: str) -> str:
        terms = (f"({u})[{i}] * ({v})[{j}] - ({u})[{j}] * ({v})[{i}]" for i, j in ((2, 3), (3, 1), (1, 2)))
        return f"[{', '.join(terms)}]"

    return f"""
xs AS (SELECT dataset_id, row_id, features[1] AS x1, features[2] AS x2, features[3] AS x3 FROM samples),
m AS (
  SELECT dataset_id, count(*) AS n, [avg(x1), avg(x2), avg(x3)] AS mean,
         [stddev_pop(x1), stddev_pop(x2), stddev_pop(x3)] AS std, {entries} FROM xs GROUP BY dataset_id),
q AS (SELECT *, (a11 + a22 + a33) / 3 AS q FROM m),
p AS (
  SELECT *, sqrt(((a11 - q) ** 2 + (a22 - q) ** 2 + (a33 - q) ** 2 + 2 * (a12 ** 2 + a13 ** 2 + a23 ** 2)) / 6) AS p
  FROM q),
angle AS (
  SELECT *, acos(greatest(-1, least(1, ((a11 - q) * ((a22 - q) * (a33 - q) - a23 * a23)
         - a12 * (a12 * (a33 - q) - a23 * a13) + a13 * (a12 * a23 - (a22 - q) * a13)) / (2 * p ** 3)))) / 3 AS phi FROM p),
ends AS (SELECT *, q + 2 * p * cos(phi) AS top, q + 2 * p * cos(phi + 2 * pi() / 3) AS low FROM angle),
pairs AS (
  SELECT *, unnest([0, 1, 2]) AS component, unnest([top, 3 * q - top - low, low]) AS l FROM ends),
crossed AS (
  SELECT *, unnest([{cross(rows[0], rows[1])}, {cross(rows[0], rows[2])}, {cross(rows[1], rows[2])}]) AS v FROM pairs),
longest AS (
  SELECT dataset_id, component, any_value(n) AS n, any_value(l) AS l, any_value(mean) AS mean, any_value(std) AS std,
         arg_max(v, v[1] ** 2 + v[2] ** 2 + v[3] ** 2) AS v FROM crossed GROUP BY dataset_id, component),
signed AS (
  SELECT *, sqrt(v[1] ** 2 + v[2] ** 2 + v[3] ** 2) * CASE
         WHEN abs(v[1]) >= abs(v[2]) AND abs(v[1]) >= abs(v[3]) THEN sign(v[1])
         WHEN abs(v[2]) >= abs(v[3]) THEN sign(v[2]) ELSE sign(v[3]) END AS length FROM longest),
eigen AS (
  SELECT *, [v[1] / length, v[2] / length, v[3] / length] AS vector, sum(l) OVER (PARTITION BY dataset_id) AS total
  FROM signed)"""


def _eigen(shaped, scaled: bool):
    base = sized(per_feature.feature_base(shaped))
    return spectral.eigen(pairs.cross_products(shaped, base), base, scaled=scaled)


@query(
    "mf26_first_row_scores_events",
    f"""WITH {x.EVENTS}, {eigen_sql(False)},
scores AS (
  SELECT xs.dataset_id, component, row_id,
         (x1 - mean[1]) * vector[1] + (x2 - mean[2]) * vector[2] + (x3 - mean[3]) * vector[3] AS s
  FROM xs JOIN eigen USING (dataset_id)),
first AS (
  SELECT dataset_id, component, arg_min(s, row_id) * CASE WHEN -min(s) > max(s) THEN -1 ELSE 1 END AS s
  FROM scores GROUP BY dataset_id, component),
centred AS (SELECT dataset_id, s - avg(s) OVER (PARTITION BY dataset_id) AS d FROM first),
moments AS (
  SELECT dataset_id, avg(d ** 2) AS m2, avg(d ** 3) AS m3, avg(d ** 4) AS m4 FROM centred GROUP BY dataset_id)
SELECT dataset_id, unnest(['first_pca_std', 'first_pca_skewness', 'first_pca_kurtosis']) AS name,
       unnest([{r('sqrt(m2)')}, {r('m3 / m2 ** 1.5')}, {r('m4 / m2 ** 2 - 3')}]) AS value
FROM moments""",
)
def mf26_first_row_scores_events(spark, sf):
    shaped = x.events(spark, sf)
    return rounded(spectral.first_row_scores(shaped, _eigen(shaped, False)), "value")


_SHARES = ", ".join(
    f"{r(f'max(CASE WHEN component = {k} THEN l / total END)')} AS pca_expl_ratio_{k + 1}, "
    f"{r(f'max(CASE WHEN component = {k} THEN sqrt(n * l) END)')} AS pca_sv_{k + 1}"
    for k in range(spectral.COMPONENTS)
)


@query(
    "mf29_pca_landmarks_events",
    f"WITH {x.EVENTS}, {eigen_sql(True)} SELECT dataset_id, {_SHARES} FROM eigen GROUP BY dataset_id",
)
def mf29_pca_landmarks_events(spark, sf):
    found = _eigen(x.events(spark, sf), True)
    return rounded(spectral.pca_landmarks(found), *spectral.SPECTRAL_NAMES)


_DISTANCE = """sum(sqrt(((x1 - mean[1]) / std[1] - vector[1]) ** 2 + ((x2 - mean[2]) / std[2] - vector[2]) ** 2
       + ((x3 - mean[3]) / std[3] - vector[3]) ** 2) * total / l)"""


@query(
    "det9_pca_scores_events",
    f"""WITH {x.EVENTS}, {eigen_sql(True)}
SELECT xs.dataset_id, row_id, {r(_DISTANCE)} AS score
FROM xs JOIN eigen USING (dataset_id) GROUP BY xs.dataset_id, row_id""",
)
def det9_pca_scores_events(spark, sf):
    shaped = x.events(spark, sf)
    return rounded(spectral.pca_scores(shaped, _eigen(shaped, True)), "score")
