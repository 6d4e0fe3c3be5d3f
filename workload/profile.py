"""Meta-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayfinder.functions.scalar import SUMMARY_PARTS
from strayfinder.operators import hbos, iforest, loda, pairs, per_feature, pooled, spectral
from strayfinder.plans.profile import profile, statistics
from strayfinder.session import sized
from strayfinder.sources.datasets import validation
from workload import fixtures as x
from workload.registry import TINY, digits, query, r, rounded, rs


def summaries_sql(source: str, blocks: list[str]) -> str:
    """SELECT (dataset_id, name, value) of the six-number summaries of ``blocks`` of ``source``."""
    names = ", ".join(f"'{b}'" for b in blocks)
    values = ", ".join(f"CAST({b} AS DOUBLE)" for b in blocks)
    parts = ", ".join(f"'{p}'" for p in SUMMARY_PARTS)
    return f"""
SELECT dataset_id, block || '_' || part AS name, {r('value')} AS value FROM (
  SELECT dataset_id, block, unnest([{parts}]) AS part, unnest([lo, hi, mean, std,
      CASE WHEN std > 1e-12 * greatest(1.0, abs(mean)) THEN m3 / pow(std, 3) END,
      CASE WHEN std > 1e-12 * greatest(1.0, abs(mean)) THEN m4 / pow(std, 4) - 3 END]) AS value
  FROM (SELECT dataset_id, block, min(v) AS lo, max(v) AS hi, avg(v) AS mean,
               stddev_pop(v) AS std, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4
        FROM (SELECT *, avg(v) OVER (PARTITION BY dataset_id, block) AS m
              FROM (SELECT dataset_id, unnest([{names}]) AS block, unnest([{values}]) AS v
                    FROM {source}))
        GROUP BY dataset_id, block))"""


# ------------------------------------------------------------------------------- pooled

_COUNT_COLUMNS = (
    "n_samples", "n_features", "has_outliers_15iqr", "has_outliers_3iqr", "has_outliers_1_99",
    "has_outliers_3std",
)
_POOLED_DOUBLES = [c for c in pooled.POOLED_NAMES if c not in _COUNT_COLUMNS]


def pooled_sql(fixture: str, scale: float = 0.01) -> str:
    """All 29 pooled features by sorting and exact quantiles."""
    p = {k: v * scale for k, v in pooled.PERCENTILES.items()}
    return f"""
WITH {fixture}, {x.CELLS},
base AS (
  SELECT dataset_id, count(*) FILTER (WHERE f_idx = 0) AS n_samples,
         CAST(max(f_idx) + 1 AS BIGINT) AS n_features, count(*) AS n_cells,
         avg(value) AS sample_mean, median(value) AS sample_median, var_pop(value) AS sample_var,
         min(value) AS sample_min, max(value) AS sample_max, stddev_pop(value) AS sample_std,
         quantile_cont(value, {p['q1']!r}) AS q1, quantile_cont(value, {p['q25']!r}) AS q25,
         quantile_cont(value, {p['q75']!r}) AS q75, quantile_cont(value, {p['q99']!r}) AS q99,
         mad(value) AS med_abs_dev
  FROM cells GROUP BY dataset_id),
shifted AS (
  SELECT dataset_id, value - least(sample_min, 0.0) + 0.0000001 AS v, n_cells AS n,
         row_number() OVER (PARTITION BY dataset_id ORDER BY value) AS i
  FROM cells JOIN base USING (dataset_id)),
g AS (
  SELECT dataset_id, sum((2 * i - n - 1) * v) / (max(n) * sum(v)) AS sample_gini
  FROM shifted GROUP BY dataset_id),
spread AS (
  SELECT dataset_id, avg(abs(value - sample_mean)) AS avg_abs_dev,
         count(*) FILTER (WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS a,
         count(*) FILTER (WHERE value < q25 - 3 * (q75 - q25) OR value > q75 + 3 * (q75 - q25)) AS b,
         count(*) FILTER (WHERE value < q1 OR value > q99) AS c,
         count(*) FILTER (WHERE value < sample_mean - 3 * sample_std OR value > sample_mean + 3 * sample_std) AS d
  FROM cells JOIN base USING (dataset_id) GROUP BY dataset_id),
full_row AS (
  SELECT *, q75 - q25 AS iqr, sample_mean / nullif(sample_max, 0) AS normalized_mean,
         sample_median / nullif(sample_max, 0) AS normalized_median,
         sample_max - sample_min AS sample_range,
         (q75 - q25) / nullif(q75 + q25, 0) AS quant_coeff_disp,
         sample_var / nullif(sample_mean, 0) AS coeff_var,
         a / n_samples AS percent_outliers_15iqr, b / n_samples AS percent_outliers_3iqr,
         c / n_samples AS percent_outliers_1_99, d / n_samples AS percent_outliers_3std,
         CAST(a > 0 AS INTEGER) AS has_outliers_15iqr, CAST(b > 0 AS INTEGER) AS has_outliers_3iqr,
         CAST(c > 0 AS INTEGER) AS has_outliers_1_99, CAST(d > 0 AS INTEGER) AS has_outliers_3std
  FROM base JOIN g USING (dataset_id) JOIN spread USING (dataset_id))
SELECT dataset_id, {', '.join(_COUNT_COLUMNS)}, {rs(*_POOLED_DOUBLES)} FROM full_row"""


@query("mf1_mf15_pooled", pooled_sql(x.LINEITEM))
def mf1_mf15_pooled(spark, sf):
    return rounded(pooled.pooled(x.lineitem(spark, sf)), *_POOLED_DOUBLES)


@query("mf5_quartiles", pooled_sql(x.EVENTS, 1.0))
def mf5_quartiles(spark, sf):
    return rounded(pooled.pooled(x.events(spark, sf), quantile_scale=1.0), *_POOLED_DOUBLES)


@query("mf9_gini_groups", pooled_sql(x.PARTS))
def mf9_gini_groups(spark, sf):
    return rounded(pooled.pooled(x.parts(spark, sf)), *_POOLED_DOUBLES)


@query(
    "w1_running_counts",
    f"""
WITH {x.EVENTS}, {x.CELLS},
counts AS (SELECT dataset_id, value, count(*) AS c FROM cells GROUP BY ALL)
SELECT dataset_id, {r('value')} AS value, c,
       CAST(sum(c) OVER (PARTITION BY dataset_id ORDER BY value) AS BIGINT) AS upto
FROM counts""",
)
def w1_running_counts(spark, sf):
    from strayfinder.session import running_sums

    counts = pooled.pooled_counts(x.events(spark, sf))
    return rounded(running_sums(counts, ["dataset_id"], "value", {"upto": "c"}), "value")


@query(
    "fn5_value_counts",
    f"""
WITH {x.LINEITEM}, {x.CELLS}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx, {r('value')} AS value, count(*) AS c
FROM cells GROUP BY dataset_id, f_idx, value""",
)
def fn5_value_counts(spark, sf):
    return rounded(pooled.value_counts(x.lineitem(spark, sf)), "value")


_PF5 = "value < sample_mean - 3 * sample_std OR value > sample_mean + 3 * sample_std"


@query(
    "pf5_outside_cells",
    f"""
WITH {x.EVENTS}, {x.KEYED_CELLS},
base AS (SELECT dataset_id, avg(value) AS sample_mean, stddev_pop(value) AS sample_std
         FROM cells GROUP BY dataset_id)
SELECT dataset_id, row_id, CAST(f_idx AS INTEGER) AS f_idx, {r('value')} AS value
FROM cells JOIN base USING (dataset_id) WHERE {_PF5}""",
)
def pf5_outside_cells(spark, sf):
    from strayfinder.sources.datasets import cells

    shaped = x.events(spark, sf)
    bounds = sized(
        pooled.pooled_base(shaped).select("dataset_id", "sample_mean", "sample_std")
    )
    outside = cells(shaped).join(bounds, "dataset_id").where(_PF5)
    return rounded(outside.select("dataset_id", "row_id", "f_idx", "value"), "value")


@query(
    "src5_validation",
    f"""
WITH {x.EMBEDDINGS}
SELECT dataset_id, count(*) AS n_rows, CAST(min(len(features)) AS INTEGER) AS min_width,
       CAST(max(len(features)) AS INTEGER) AS max_width,
       CAST(sum(len(list_filter(features, lambda v: v IS NULL OR isnan(v) OR isinf(v)))) AS BIGINT) AS bad_cells
FROM samples GROUP BY dataset_id""",
)
def src5_validation(spark, sf):
    return validation(x.embeddings(spark, sf))


# ------------------------------------------------------------------------------- per feature

_BASE_SQL = """base AS (
  SELECT dataset_id, f_idx, count(*) AS n, avg(value) AS mean, var_pop(value) AS var,
         stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi
  FROM cells GROUP BY dataset_id, f_idx),
shape AS (
  SELECT dataset_id, f_idx, any_value(n) AS n, any_value(mean) AS mean, any_value(var) AS var,
         any_value(std) AS std,
         CASE WHEN any_value(std) > 1e-12 * greatest(1.0, abs(any_value(mean)))
              THEN avg(pow(value - mean, 3)) / pow(any_value(std), 3) END AS skewness,
         CASE WHEN any_value(std) > 1e-12 * greatest(1.0, abs(any_value(mean)))
              THEN avg(pow(value - mean, 4)) / pow(any_value(std), 4) - 3 END AS kurtosis,
         avg(pow(value - mean, 5)) AS moment_5, avg(pow(value - mean, 6)) AS moment_6,
         avg(pow(value - mean, 7)) AS moment_7, avg(pow(value - mean, 8)) AS moment_8,
         avg(pow(value - mean, 9)) AS moment_9, avg(pow(value - mean, 10)) AS moment_10
  FROM cells JOIN base USING (dataset_id, f_idx) GROUP BY dataset_id, f_idx)"""

_NORMAL_SQL = """z1 AS (
  SELECT *, CASE WHEN n >= 8 THEN CAST(n AS DOUBLE) END AS m FROM shape),
z2 AS (
  SELECT *, skewness * sqrt((m+1)*(m+3)/(6*(m-2))) AS y,
         3*(m*m+27*m-70)*(m+1)*(m+3)/((m-2)*(m+5)*(m+7)*(m+9)) AS b,
         (kurtosis + 3 - 3*(m-1)/(m+1)) / sqrt(24*m*(m-2)*(m-3)/((m+1)*(m+1)*(m+3)*(m+5))) AS x,
         6*(m*m-5*m+2)/((m+7)*(m+9)) * sqrt(6*(m+3)*(m+5)/(m*(m-2)*(m-3))) AS s
  FROM z1),
z3 AS (SELECT *, -1 + sqrt(2*(b-1)) AS w, 6 + 8/s*(2/s + sqrt(1+4/(s*s))) AS a FROM z2),
z4 AS (
  SELECT *, asinh(y / sqrt(2/(w-1))) / sqrt(0.5*ln(w)) AS zs, 1 + x*sqrt(2/(a-4)) AS q FROM z3),
z5 AS (
  SELECT *, (1 - 2/(9*a) - sign(q)*cbrt((1-2/a)/abs(q))) / sqrt(2/(9*a)) AS zk FROM z4),
normal AS (
  SELECT *, exp(-(zs*zs + zk*zk)/2) AS normality_p,
         CAST(coalesce(exp(-(zs*zs + zk*zk)/2) < 0.05, false) AS INTEGER) AS is_normal_5,
         CAST(coalesce(exp(-(zs*zs + zk*zk)/2) < 0.01, false) AS INTEGER) AS is_normal_1
  FROM z5)"""

_COUNT_SQL = """vc AS (SELECT dataset_id, f_idx, value, count(*)::DOUBLE AS c FROM cells GROUP BY ALL),
counted AS (
  SELECT dataset_id, f_idx, count(*) / sum(c) AS sparsity,
         (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / sum(c) AS entropy
  FROM vc GROUP BY dataset_id, f_idx)"""


def _feature_sql(fixture: str) -> str:
    return f"WITH {fixture}, {x.CELLS}, {_BASE_SQL}, {_NORMAL_SQL}, {_COUNT_SQL}"


_SCALED = [f"moment_{k}" for k in per_feature.MOMENT_ORDERS]


@query(
    "mf16_mf17_normality",
    f"""{_feature_sql(x.PARTS)}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx, n, {rs('normality_p')}, is_normal_5, is_normal_1
FROM normal""",
)
def mf16_mf17_normality(spark, sf):
    base = per_feature.feature_base(x.parts(spark, sf))
    out = per_feature.normality(base).select(
        "dataset_id", "f_idx", "n", "normality_p", "is_normal_5", "is_normal_1"
    )
    return rounded(out, "normality_p")


@query(
    "mf18_moments",
    f"""{_feature_sql(x.LINEITEM)}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx,
       {', '.join(f"{r(f'moment_{k} / pow(std, {k})')} AS moment_{k}" for k in per_feature.MOMENT_ORDERS)}
FROM shape""",
)
def mf18_moments(spark, sf):
    return per_feature.feature_base(x.lineitem(spark, sf)).select(
        "dataset_id",
        "f_idx",
        *[
            digits(F.col(f"moment_{k}") / F.pow("std", F.lit(k))).alias(f"moment_{k}")
            for k in per_feature.MOMENT_ORDERS
        ],
    )


@query(
    "mf19_mf20_shape",
    f"""{_feature_sql(x.EVENTS)}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx, n, {rs('mean', 'std', 'skewness', 'kurtosis')}
FROM shape""",
)
def mf19_mf20_shape(spark, sf):
    base = per_feature.feature_base(x.events(spark, sf))
    columns = ("mean", "std", "skewness", "kurtosis")
    return rounded(base.select("dataset_id", "f_idx", "n", *columns), *columns)


@query(
    "mf21_mf22_counts",
    f"""{_feature_sql(x.LINEITEM)}
SELECT dataset_id, CAST(f_idx AS INTEGER) AS f_idx, {rs('sparsity', 'entropy')} FROM counted""",
)
def mf21_mf22_counts(spark, sf):
    out = per_feature.count_features(pooled.value_counts(x.lineitem(spark, sf)))
    return rounded(out, "sparsity", "entropy")


_SUM6_BLOCKS = [
    "normality_p", "is_normal_5", "is_normal_1", "skewness", "kurtosis", "sparsity", "entropy",
]


@query(
    "sum6_feature_summaries",
    f"""{_feature_sql(x.EVENTS)},
joined AS (SELECT * FROM normal JOIN counted USING (dataset_id, f_idx))
{summaries_sql('joined', _SUM6_BLOCKS)}""",
)
def sum6_feature_summaries(spark, sf):
    stats = per_feature.feature_stats(x.events(spark, sf))
    return rounded(
        per_feature.feature_summaries(stats, tuple(_SUM6_BLOCKS)), "value")


# ------------------------------------------------------------------------------- pairs

_PAIR_SQL = """pairs AS (
  SELECT a.dataset_id, a.f_idx AS i, b.f_idx AS j, any_value(a.n) AS n,
         any_value((a.n * (a.mean-b.mean)*(a.mean-b.mean)/2)
                   / nullif(a.n*(a.var+b.var)/(2*a.n-2), 0)) AS anova_f,
         sum((ca.value - a.mean) * (cb.value - b.mean)) AS s,
         any_value(a.std * b.std) AS ss, any_value(a.var = 0 OR b.var = 0) AS flat
  FROM base a JOIN base b ON a.dataset_id = b.dataset_id AND a.f_idx > b.f_idx
  JOIN cells ca ON ca.dataset_id = a.dataset_id AND ca.f_idx = a.f_idx
  JOIN cells cb ON cb.dataset_id = b.dataset_id AND cb.f_idx = b.f_idx AND cb.row_id = ca.row_id
  GROUP BY a.dataset_id, a.f_idx, b.f_idx),
pair_stats AS (
  SELECT *, CASE WHEN flat THEN 0.0 ELSE s / n / ss END AS correlation,
         s / nullif(n - 1, 0) AS covariance FROM pairs)"""


def _pair_stats(shaped):
    base = sized(per_feature.feature_base(shaped))
    return pairs.pair_stats(pairs.cross_products(shaped, base), base)


@query(
    "mf23_mf24_mf25_pairs",
    f"""WITH {x.EMBEDDINGS}, {x.KEYED_CELLS}, {_BASE_SQL}, {_PAIR_SQL}
SELECT dataset_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, n,
       {rs('correlation', 'covariance', 'anova_f')}
FROM pair_stats""",
)
def mf23_mf24_mf25_pairs(spark, sf):
    out = _pair_stats(x.embeddings(spark, sf)).drop("anova_p_value")
    return rounded(out, "correlation", "covariance", "anova_f")


@query(
    "j3_feature_pairs",
    f"""WITH {x.EVENTS}, {x.KEYED_CELLS}, {_BASE_SQL}, {_PAIR_SQL}
SELECT dataset_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, n,
       {rs('correlation', 'covariance', 'anova_f')}
FROM pair_stats""",
)
def j3_feature_pairs(spark, sf):
    out = _pair_stats(x.events(spark, sf)).drop("anova_p_value")
    return rounded(out, "correlation", "covariance", "anova_f")


@query(
    "mf23_mf24_summaries",
    f"""WITH {x.EVENTS}, {x.KEYED_CELLS}, {_BASE_SQL}, {_PAIR_SQL}
{summaries_sql('pair_stats', ['correlation', 'covariance'])}""",
)
def mf23_mf24_summaries(spark, sf):
    blocks = ("correlation", "covariance")
    out = pairs.pair_summaries(_pair_stats(x.events(spark, sf)), blocks)
    return rounded(out, "value")


# With an even number of degrees of freedom the tail is a series of products of odd over even numbers:
# its first terms for small f, where the tail is large, and the rest of them otherwise.
@query(
    "mf25_mat8_anova_p_events",
    f"""WITH {x.EVENTS}, cells AS (
  SELECT dataset_id, unnest(range(3)) AS f_idx, unnest(features) AS value FROM samples),
stat AS (
  SELECT dataset_id, f_idx, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM cells GROUP BY ALL),
f AS (
  SELECT a.dataset_id, a.f_idx AS i, b.f_idx AS j, 2.0 * a.n - 2 AS df, a.n - 1 AS m,
         (a.n * (a.mean - b.mean) ** 2 / 2) / (a.n * (a.var + b.var) / (2 * a.n - 2)) AS f
  FROM stat a JOIN stat b ON a.dataset_id = b.dataset_id AND a.f_idx > b.f_idx),
w AS (
  SELECT k, sum(CASE WHEN k = 0 THEN 0 ELSE ln((2 * k - 1) / (2.0 * k)) END) OVER (ORDER BY k) AS lw
  FROM range(600000) t(k)),
part AS (
  SELECT dataset_id, i, j, f, df, sqrt(f / (df + f)) * sum(exp(lw + k * ln(df / (df + f)))) AS s
  FROM f JOIN w ON CASE WHEN f < 4 THEN k < m ELSE k >= m AND k < m + 30 * (df + f) / f END
  GROUP BY dataset_id, i, j, f, df)
SELECT dataset_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('f')} AS anova_f,
       {r('CASE WHEN f < 4 THEN 1 - s ELSE s END', TINY)} AS anova_p_value
FROM part""",
)
def mf25_mat8_anova_p_events(spark, sf):
    found = _pair_stats(x.events(spark, sf))
    found = found.select("dataset_id", "i", "j", "anova_f", "anova_p_value")
    return rounded(rounded(found, "anova_f"), "anova_p_value", floor=TINY)


@query("mat8_anova_p")
def mat8_anova_p(spark, sf):
    return rounded(_pair_stats(x.parts(spark, sf)), "correlation", "covariance", "anova_f", "anova_p_value")


@query(
    "fn3_flatten_diagonally",
    f"""WITH {x.EVENTS}, {x.KEYED_CELLS}, {_BASE_SQL},
entries AS (
  SELECT ca.dataset_id, ca.f_idx AS i, cb.f_idx AS j,
         sum((ca.value - a.mean) * (cb.value - b.mean)) AS v
  FROM cells ca JOIN cells cb ON ca.dataset_id = cb.dataset_id AND ca.row_id = cb.row_id
  JOIN base a ON a.dataset_id = ca.dataset_id AND a.f_idx = ca.f_idx
  JOIN base b ON b.dataset_id = cb.dataset_id AND b.f_idx = cb.f_idx
  GROUP BY ca.dataset_id, ca.f_idx, cb.f_idx),
sized AS (SELECT *, max(i) OVER (PARTITION BY dataset_id) + 1 AS n FROM entries)
SELECT dataset_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('v')} AS v,
       CAST((n - 1) - (i - j) AS INTEGER) AS diag,
       row_number() OVER (PARTITION BY dataset_id ORDER BY (n - 1) - (i - j), i) - 1 AS position
FROM sized""",
)
def fn3_flatten_diagonally(spark, sf):
    shaped = x.events(spark, sf)
    base = sized(per_feature.feature_base(shaped))
    lower = pairs.cross_products(shaped, base)
    both = lower.select(
        "dataset_id",
        F.inline(
            F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", F.col("s").alias("v"))))
            .otherwise(
                F.array(
                    F.struct("i", "j", F.col("s").alias("v")),
                    F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("v")),
                )
            )
        ),
    )
    width = base.groupBy("dataset_id").agg((F.max("f_idx") + 1).alias("n"))
    out = pairs.flatten_diagonally(both.join(width, "dataset_id"))
    return rounded(out.select("dataset_id", "i", "j", "v", "diag", "position"), "v")


# ------------------------------------------------------------------------------- landmarks

_BIN_SQL = """ranges AS (
  SELECT dataset_id, f_idx, n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
         CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM base),
placed AS (
  SELECT *, least(CAST(floor((value - lo) * ({b}.0 / (hi - lo))) AS INTEGER), {b} - 1) AS i0,
         (hi - lo) / {b}.0 AS st
  FROM cells JOIN ranges USING (dataset_id, f_idx)),
binned AS (
  SELECT *, CASE WHEN value < i0 * st + lo THEN i0 - 1
                 WHEN value >= (i0 + 1) * st + lo AND i0 < {b} - 1 THEN i0 + 1 ELSE i0 END AS bin
  FROM placed),
hist AS (
  SELECT dataset_id, f_idx, bin, count(*) AS c, any_value(n) AS n, any_value(lo) AS lo,
         any_value(st) AS width, count(*) / (any_value(n) * any_value(st)) AS density
  FROM binned GROUP BY dataset_id, f_idx, bin)"""


@query(
    "mf27_hbos_landmarks",
    f"""WITH {x.LINEITEM}, {x.CELLS}, {_BASE_SQL}, {_BIN_SQL.format(b=10)},
landmarks AS (
  SELECT dataset_id, f_idx, sum(density) / 10 AS HBOS_mean, max(density) AS HBOS_max,
         CASE WHEN count(*) < 10 THEN 0.0 ELSE min(density) END AS HBOS_min
  FROM hist GROUP BY dataset_id, f_idx)
{summaries_sql('landmarks', ['HBOS_mean', 'HBOS_max', 'HBOS_min'])}""",
)
def mf27_hbos_landmarks(spark, sf):
    shaped = x.lineitem(spark, sf)
    base = sized(per_feature.feature_base(shaped))
    out = hbos.hbos_landmarks(hbos.histogram(shaped, base, 10))
    return rounded(out, "value")


def loda_sql(fixture: str, bins: int, cuts: int, seed: int = 0) -> str:
    """Weights, projections and histograms of the random cuts in SQL."""
    return f"""
WITH {fixture}, {x.KEYED_CELLS},
widths AS (SELECT dataset_id, max(len(features)) AS p FROM samples GROUP BY dataset_id),
digests AS (
  SELECT dataset_id, p, cut, f_idx, md5('{seed}:' || cut || ':' || f_idx) AS h
  FROM (SELECT dataset_id, p, cut, unnest(range(p)) AS f_idx
        FROM (SELECT dataset_id, p, unnest(range({cuts})) AS cut FROM widths))),
weights AS (
  SELECT dataset_id, cut, f_idx,
         sqrt(-2.0 * ln((('0x' || substr(h, 1, 8))::BIGINT + 0.5) / 4294967296.0))
         * cos(2.0 * pi() * ((('0x' || substr(h, 9, 8))::BIGINT + 0.5) / 4294967296.0)) AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, cut ORDER BY substr(h, 17)) AS k
        FROM digests)
  WHERE k <= greatest(1, floor(sqrt(p)))),
projected AS (
  SELECT c.dataset_id, c.row_id, w.cut, sum(c.value * w.w) AS z
  FROM cells c JOIN weights w ON c.dataset_id = w.dataset_id AND c.f_idx = w.f_idx
  GROUP BY c.dataset_id, c.row_id, w.cut),
limits AS (
  SELECT dataset_id, cut, CASE WHEN min(z) = max(z) THEN min(z) - 0.5 ELSE min(z) END AS lo,
         CASE WHEN min(z) = max(z) THEN max(z) + 0.5 ELSE max(z) END AS hi
  FROM projected GROUP BY dataset_id, cut),
binned AS (
  SELECT *, greatest(0, CASE WHEN z < i0 * st + lo THEN i0 - 1
                 WHEN z >= (i0 + 1) * st + lo AND i0 < {bins} - 1 THEN i0 + 1 ELSE i0 END) AS bin
  FROM (SELECT *, least(CAST(floor((z - lo) * ({bins}.0 / (hi - lo))) AS INTEGER), {bins} - 1) AS i0,
               (hi - lo) / {bins}.0 AS st
        FROM projected JOIN limits USING (dataset_id, cut))),
probs AS (
  SELECT dataset_id, cut, bin, (coalesce(c, 0) + 1e-12) / sum(coalesce(c, 0) + 1e-12)
           OVER (PARTITION BY dataset_id, cut) AS prob
  FROM (SELECT dataset_id, cut, unnest(range({bins})) AS bin FROM limits)
  LEFT JOIN (SELECT dataset_id, cut, bin, count(*) AS c FROM binned GROUP BY ALL)
       USING (dataset_id, cut, bin))"""


_LODA_BIN = ["LODA_n_hists_mean", "LODA_n_hists_max"]
_LODA_CUT = ["LODA_n_cuts_mean", "LODA_n_cuts_max"]


@query(
    "mf30_loda_landmarks",
    f"""{loda_sql(x.EMBEDDINGS, 10, 100)},
per_bin AS (SELECT dataset_id, bin, avg(prob) AS LODA_n_hists_mean, max(prob) AS LODA_n_hists_max
            FROM probs GROUP BY dataset_id, bin),
per_cut AS (SELECT dataset_id, cut, avg(prob) AS LODA_n_cuts_mean, max(prob) AS LODA_n_cuts_max
            FROM probs GROUP BY dataset_id, cut),
bins AS ({summaries_sql('per_bin', _LODA_BIN)}),
cuts AS ({summaries_sql('per_cut', _LODA_CUT)})
SELECT * FROM bins UNION ALL SELECT * FROM cuts""",
)
def mf30_loda_landmarks(spark, sf):
    out = loda.loda_landmarks(loda.loda_fit(x.embeddings(spark, sf), 10, 100))
    return rounded(out, "value")


def _hex(text: str, at: int, size: int) -> str:
    return f"('0x' || substr({text}, {at}, {size}))::BIGINT"


def forest_sql(fixture: str, trees: int, share: float = 1.0, seed: int = 0) -> str:
    """Isolation trees in SQL, level by level: their rows, the ``splits`` (f, cut) and the ``nodes``."""
    prime, unit = iforest.PRIME, "4503599627370496.0::DOUBLE"
    key = f"'{seed}:' || dataset_id || ':' || tree || ':'"
    levels = "".join(
        f"""
s{k} AS MATERIALIZED (
  SELECT dataset_id, tree, node, f, CASE WHEN cut >= hi THEN lo ELSE cut END AS cut
  FROM (SELECT *, lo + {_hex('h', 14, 13)} / {unit} * (hi - lo) AS cut
        FROM (SELECT *, md5({key} || node) AS h,
                     row_number() OVER (PARTITION BY dataset_id, tree, node ORDER BY f) - 1 AS pick,
                     count(*) OVER (PARTITION BY dataset_id, tree, node) AS n
              FROM (SELECT dataset_id, tree, node, f, min(features[f + 1]) AS lo, max(features[f + 1]) AS hi
                    FROM l{k} JOIN used USING (dataset_id, tree)
                    WHERE {k} < ceil(log2(greatest(size, 2))) GROUP BY dataset_id, tree, node, f)
              WHERE hi > lo))
  WHERE pick = floor({_hex('h', 1, 13)} / {unit} * n)),
l{k + 1} AS MATERIALIZED (
  SELECT dataset_id, tree, row_id, features, target, size,
         2 * node + CASE WHEN features[f + 1] > cut THEN 1 ELSE 0 END AS node
  FROM l{k} JOIN s{k} USING (dataset_id, tree, node))"""
        + ","
        for k in range(8)
    )
    grown = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM l{k}" for k in range(9))
    return f"""WITH {fixture},
widths AS (
  SELECT dataset_id, p, greatest(1, CAST(floor({share!r}::DOUBLE * p) AS INTEGER)) AS width
  FROM (SELECT dataset_id, max(len(features)) AS p FROM samples GROUP BY dataset_id)),
hashed AS (
  SELECT *, {_hex('m', 1, 8)} % {prime} AS one, {_hex('m', 9, 8)} % {prime} AS two
  FROM (SELECT dataset_id, row_id, features, md5(CAST(row_id AS VARCHAR)) AS m FROM samples)),
maps AS (
  SELECT tree, {_hex('m', 1, 8)} % {prime - 1} + 1 AS a1, {_hex('m', 9, 8)} % {prime} AS b1,
         {_hex('m', 17, 8)} % {prime - 1} + 1 AS a2, {_hex('m', 25, 8)} % {prime} AS b2
  FROM (SELECT tree, md5('{seed}:' || tree) AS m FROM range({trees}) t(tree))),
drawn AS (
  SELECT dataset_id, tree, row_id, features FROM hashed, maps
  QUALIFY row_number() OVER (
    PARTITION BY dataset_id, tree
    ORDER BY (a1 * one + b1) % {prime} * {prime} + (a2 * two + b2) % {prime}, row_id) <= {iforest.SUBSAMPLE}),
used AS MATERIALIZED (
  SELECT dataset_id, tree, f FROM (
    SELECT dataset_id, tree, width, f,
           row_number() OVER (PARTITION BY dataset_id, tree ORDER BY md5({key} || 'f:' || f)) AS place
    FROM (SELECT dataset_id, width, tree, unnest(range(p)) AS f FROM widths, maps))
  WHERE place <= width),
l0 AS MATERIALIZED (
  SELECT dataset_id, tree, row_id, features, {_hex("md5(" + key + " || 'r:' || row_id)", 1, 13)} / {unit} AS target,
         count(*) OVER (PARTITION BY dataset_id, tree) AS size, CAST(1 AS BIGINT) AS node
  FROM drawn),{levels}
splits AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM s{k}' for k in range(8))}),
nodes AS MATERIALIZED (
  SELECT n.*, s.node IS NULL AS leaf,
         depth + CASE WHEN c <= 1 THEN 0.0::DOUBLE WHEN c = 2 THEN 1.0::DOUBLE
                      ELSE 2 * (ln(c - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (c - 1.0::DOUBLE) / c END AS path
  FROM (SELECT dataset_id, tree, node, any_value(depth) AS depth, count(*) AS c,
               sum(target * target) - sum(target) * sum(target) / count(*) AS err
        FROM ({grown}) GROUP BY dataset_id, tree, node) n
  LEFT JOIN splits s USING (dataset_id, tree, node))"""


@query("mf26_first_row_scores")
def mf26_first_row_scores(spark, sf):
    shaped = x.events(spark, sf)
    base = sized(per_feature.feature_base(shaped))
    pairs_ = spectral.eigen(pairs.cross_products(shaped, base), base)
    return spectral.first_row_scores(shaped, pairs_)


_IFOREST = list(iforest.IFOREST_BLOCKS)


@query(
    "mf28_iforest_landmarks",
    f"""{forest_sql(x.EVENTS, 100)},
gains AS (
  SELECT s.dataset_id, s.tree, s.f, sum(n.err - a.err - b.err) AS gain
  FROM splits s JOIN nodes n USING (dataset_id, tree, node)
  JOIN nodes a ON a.dataset_id = s.dataset_id AND a.tree = s.tree AND a.node = 2 * s.node
  JOIN nodes b ON b.dataset_id = s.dataset_id AND b.tree = s.tree AND b.node = 2 * s.node + 1
  GROUP BY s.dataset_id, s.tree, s.f),
shares AS (SELECT dataset_id, tree, sum(gain) AS total, max(gain) AS top FROM gains GROUP BY dataset_id, tree),
shapes AS (
  SELECT dataset_id, tree, count(*) FILTER (leaf) AS IForest_n_leaves, max(depth) AS IForest_n_depth,
         CASE WHEN any_value(total) > 0 THEN 1.0 / any_value(width) ELSE 0.0 END AS IForest_fi_mean,
         CASE WHEN any_value(total) > 0 THEN any_value(top) / any_value(total) ELSE 0.0 END AS IForest_fi_max
  FROM nodes LEFT JOIN shares USING (dataset_id, tree) JOIN widths USING (dataset_id)
  GROUP BY dataset_id, tree)
{summaries_sql('shapes', _IFOREST)}""",
)
def mf28_iforest_landmarks(spark, sf):
    return rounded(iforest.iforest_landmarks(iforest.iforest_fit(x.events(spark, sf))), "value")


@query("mf29_pca_landmarks")
def mf29_pca_landmarks(spark, sf):
    shaped = x.embeddings(spark, sf)
    base = sized(per_feature.feature_base(shaped))
    return spectral.pca_landmarks(
        spectral.eigen(pairs.cross_products(shaped, base), base, scaled=True)
    )


@query("profile_statistics")
def profile_statistics(spark, sf):
    return statistics(x.lineitem(spark, sf))


@query("profile_all")
def profile_all(spark, sf):
    return profile(x.events(spark, sf))
