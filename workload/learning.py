"""Evaluation, ranking, factorisation and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strayfinder.operators import transform
from strayfinder.operators.evaluate import ensemble_mean, masked_mse, mean_ndcg, ndcg
from strayfinder.operators.ranking import best_item, nth_model, ranked_models, top_models
from strayfinder.plans import factorize
from strayfinder.plans.history import stopping_history
from strayfinder.plans.profile import meta_vectors, profile
from strayfinder.plans.recommend import (
    complete_performance,
    fit_recommender,
    named_ranking,
    similar_datasets,
)
from strayfinder.session import durable
from strayfinder.sources.catalog import model_catalog
from strayfinder.sources.datasets import samples
from workload import fixtures as x
from workload.registry import digits, query, r, rounded, rs
from workload.tables import CATALOG

# ------------------------------------------------------------------------------- joins


@query(
    "j1_meta_performance",
    f"""WITH {x.SUPPLIER_META}, {x.PERFORMANCE}
SELECT CAST(idx AS INTEGER) AS idx, model_id, count(*) AS n, {r('sum(value * ap) / sum(ap)')} AS weighted
FROM meta JOIN performance USING (dataset_id) GROUP BY idx, model_id HAVING sum(ap) > 0""",
)
def j1_meta_performance(spark, sf):
    joined = x.supplier_meta(spark, sf).join(x.performance(spark, sf), "dataset_id")
    out = joined.groupBy("idx", "model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value") * F.col("ap")).alias("_s"),
        F.sum("ap").alias("_w"),
    )
    return out.where("_w > 0").select(
        "idx", "model_id", "n", digits(F.col("_s") / F.col("_w")).alias("weighted")
    )


# Dataset factors from lineitem and model factors from part, three numbers each.
_FACTORS_SQL = """u AS (
  SELECT 'S' || l_suppkey AS dataset_id,
         [avg(l_discount) * 10, avg(l_tax) * 10, avg(l_quantity) / 50] AS u
  FROM lineitem GROUP BY l_suppkey),
v AS (
  SELECT CAST(string_split(p_brand, '#')[2] AS INTEGER) AS model_id,
         [avg(p_size) / 50 - 0.5, avg(p_retailprice) / 1000 - 1, stddev_pop(p_size) / 15 - 1] AS v
  FROM part GROUP BY p_brand),
scores AS (SELECT dataset_id, model_id, list_dot_product(u, v) AS score FROM u, v)"""


def _dataset_factors(spark, sf):
    return (
        x.table(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("S"), "l_suppkey").alias("dataset_id"))
        .agg(
            F.array(
                F.avg("l_discount") * 10, F.avg("l_tax") * 10, F.avg("l_quantity") / 50
            ).alias("u")
        )
    )


def _model_factors(spark, sf):
    return (
        x.table(spark, sf, "part")
        .groupBy(F.element_at(F.split("p_brand", "#"), 2).cast("int").alias("model_id"))
        .agg(
            F.array(
                F.avg("p_size") / 50 - 0.5,
                F.avg("p_retailprice") / 1000 - 1,
                F.stddev_pop("p_size") / 15 - 1,
            ).alias("v")
        )
    )


@query(
    "j4_score_models",
    f"WITH {_FACTORS_SQL} SELECT dataset_id, model_id, {r('score')} AS score FROM scores",
)
def j4_score_models(spark, sf):
    scores = factorize.score_models(_dataset_factors(spark, sf), _model_factors(spark, sf))
    return rounded(scores, "score")


# ------------------------------------------------------------------------------- evaluation

# Brand models rated by the share of a supplier's revenue, against the factor scores.
_TRUTH_SQL = """truth AS (
  SELECT 'S' || l_suppkey AS dataset_id, CAST(string_split(p_brand, '#')[2] AS INTEGER) AS model_id,
         avg(l_discount) * 10 AS truth
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
scored AS (
  SELECT dataset_id, model_id, coalesce(truth, 0) AS truth, round(score, 2) AS score
  FROM scores LEFT JOIN truth USING (dataset_id, model_id))"""


def _scored(spark, sf):
    """Scores rounded to two digits, so ties occur; brands a supplier never sold have truth 0."""
    truth = (
        x.table(spark, sf, "lineitem")
        .join(x.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.concat(F.lit("S"), "l_suppkey").alias("dataset_id"),
            F.element_at(F.split("p_brand", "#"), 2).cast("int").alias("model_id"),
        )
        .agg((F.avg("l_discount") * 10).alias("truth"))
    )
    scores = factorize.score_models(_dataset_factors(spark, sf), _model_factors(spark, sf))
    return scores.join(truth, ["dataset_id", "model_id"], "left").select(
        "dataset_id",
        "model_id",
        F.coalesce("truth", F.lit(0.0)).alias("truth"),
        F.round("score", 2).alias("score"),
    )


@query(
    "agg1_pf4_masked_mse",
    f"""WITH {_FACTORS_SQL}, {_TRUTH_SQL}
SELECT dataset_id, {r('avg(pow(score - truth, 2))')} AS mse FROM scored WHERE truth <> 0
GROUP BY dataset_id""",
)
def agg1_pf4_masked_mse(spark, sf):
    return rounded(masked_mse(_scored(spark, sf), "score", "truth", ("dataset_id",)), "mse")


_NDCG_SQL = """ranked AS (
  SELECT *, 1 / log2(row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC) + 1) AS d,
         1 / log2(row_number() OVER (PARTITION BY dataset_id ORDER BY truth DESC) + 1) AS ideal
  FROM scored),
tied AS (
  SELECT dataset_id, score, avg(truth) * sum(d) AS dcg, sum(truth * ideal) AS best
  FROM ranked GROUP BY dataset_id, score),
per_dataset AS (
  SELECT dataset_id, coalesce(sum(dcg) / nullif(sum(best), 0), 0) AS ndcg
  FROM tied GROUP BY dataset_id)"""


@query(
    "agg2_w2_ndcg",
    f"""WITH {_FACTORS_SQL}, {_TRUTH_SQL}, {_NDCG_SQL}
SELECT dataset_id, {r('ndcg')} AS ndcg FROM per_dataset""",
)
def agg2_w2_ndcg(spark, sf):
    return rounded(ndcg(_scored(spark, sf)), "ndcg")


@query(
    "agg3_mean_ndcg",
    f"""WITH {_FACTORS_SQL}, {_TRUTH_SQL}, {_NDCG_SQL}
SELECT {r('avg(ndcg)')} AS mean_ndcg FROM per_dataset""",
)
def agg3_mean_ndcg(spark, sf):
    return rounded(mean_ndcg(_scored(spark, sf)), "mean_ndcg")


@query(
    "agg5_ensemble_mean",
    f"""WITH {_FACTORS_SQL}, {_TRUTH_SQL}
SELECT dataset_id, model_id, {r('avg(s)')} AS score
FROM (SELECT dataset_id, model_id, score AS s FROM scored
      UNION ALL SELECT dataset_id, model_id, truth FROM scored)
GROUP BY dataset_id, model_id""",
)
def agg5_ensemble_mean(spark, sf):
    scored = _scored(spark, sf)
    two = scored.select("dataset_id", "model_id", "score").unionByName(
        scored.select("dataset_id", "model_id", F.col("truth").alias("score"))
    )
    return rounded(ensemble_mean(two), "score")


# ------------------------------------------------------------------------------- ranking

_RANK = "row_number() OVER (PARTITION BY dataset_id ORDER BY ap DESC, model_id DESC)"
_ROUND_PERF = f"perf AS (SELECT dataset_id, model_id, {r('ap')} AS ap FROM performance)"


def _perf(spark, sf):
    return rounded(x.performance(spark, sf), "ap")


@query(
    "tk1_top_models",
    f"""WITH {x.PERFORMANCE}, {_ROUND_PERF}, ranked AS (SELECT *, {_RANK} AS k FROM perf)
SELECT dataset_id, model_id, ap, CAST(k AS INTEGER) AS rank FROM ranked WHERE k <= 5""",
)
def tk1_top_models(spark, sf):
    return top_models(_perf(spark, sf), 5, score="ap")


@query(
    "tk2_tk3_nth_model",
    f"""WITH {x.PERFORMANCE}, {_ROUND_PERF}, ranked AS (SELECT *, {_RANK} AS k FROM perf)
SELECT dataset_id, model_id, ap, CAST(k AS INTEGER) AS rank FROM ranked WHERE k = 3""",
)
def tk2_tk3_nth_model(spark, sf):
    return nth_model(_perf(spark, sf), 3, score="ap")


@query(
    "tk4_best_model",
    f"""WITH {x.PERFORMANCE}, {_ROUND_PERF},
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ap DESC, model_id) AS k
           FROM perf)
SELECT dataset_id, model_id AS best FROM ranked WHERE k = 1""",
)
def tk4_best_model(spark, sf):
    return _perf(spark, sf).groupBy("dataset_id").agg(best_item("ap").alias("best"))


@query(
    "w3_rank_positions",
    f"""WITH {x.PERFORMANCE}, {_ROUND_PERF}
SELECT dataset_id, model_id, ap, CAST({_RANK} AS INTEGER) AS rank FROM perf""",
)
def w3_rank_positions(spark, sf):
    return ranked_models(_perf(spark, sf), score="ap")


# ------------------------------------------------------------------------------- factorisation


@query("rec1_mat1_embedding")
def rec1_mat1_embedding(spark, sf):
    """Dataset factors of suppliers; columns have mean 0 and population variance 1."""
    vectors = meta_vectors(transform.zero_filled(x.supplier_meta(spark, sf)))
    return factorize.embed(vectors, factorize.fit_embedding(vectors, 3))


# Small data may miss entries; like the operator, the SQL fills them with the model's mean.
_MONTH_SQL = f"""{x.MONTHLY},
complete AS (
  SELECT d.dataset_id, m.model_id, coalesce(ap, mean_ap) AS ap
  FROM (SELECT DISTINCT dataset_id FROM monthly) d,
       (SELECT model_id, avg(ap) AS mean_ap FROM monthly GROUP BY model_id) m
  LEFT JOIN monthly ON monthly.dataset_id = d.dataset_id AND monthly.model_id = m.model_id),
mu AS (
  SELECT c_mktsegment || '/' || o_orderpriority AS dataset_id,
         [avg(o_totalprice) / 250000 - 1, stddev_pop(o_totalprice) / 150000 - 1] AS u
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
mv AS (
  SELECT CAST(month(o_orderdate) - 1 AS INTEGER) AS model_id,
         [avg(o_totalprice) / 25000 - 10, stddev_pop(o_totalprice) / 15000 - 9] AS v
  FROM orders GROUP BY ALL),
pairs AS (
  SELECT mu.dataset_id, i.model_id AS i, j.model_id AS j, mu.u, i.v AS vi, j.v AS vj,
         1 / (1 + exp(list_dot_product(mu.u, i.v) - list_dot_product(mu.u, j.v))) AS sig
  FROM mu, mv i, mv j WHERE i.model_id <> j.model_id),
phi AS (
  SELECT dataset_id, i, 1.5 + sum(sig) AS phi, sum(sig * (1 - sig)) AS own,
         sum(sig * (1 - sig) * (vj[1] - vi[1])) AS r1, sum(sig * (1 - sig) * (vj[2] - vi[2])) AS r2,
         any_value(u) AS u
  FROM pairs GROUP BY dataset_id, i),
weighted AS (
  SELECT phi.*, ap, (pow(10, ap) - 1) / (phi * pow(ln(phi), 2)) AS w
  FROM phi JOIN complete ON complete.dataset_id = phi.dataset_id AND complete.model_id = phi.i)"""


def _month_factors(spark, sf):
    orders = x.table(spark, sf, "orders").join(
        x.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    price, spread = F.avg("o_totalprice"), F.stddev_pop("o_totalprice")
    u = orders.groupBy(
        F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("dataset_id")
    ).agg(F.array(price / 250000 - 1, spread / 150000 - 1).alias("u"))
    v = x.table(spark, sf, "orders").groupBy(
        (F.month("o_orderdate") - 1).cast("int").alias("model_id")
    ).agg(F.array(price / 25000 - 10, spread / 15000 - 9).alias("v"))
    table = x.monthly(spark, sf)
    ratings = factorize.rating_vectors(
        complete_performance(table, table.select("dataset_id").distinct())
    )
    return u, v, ratings


@query(
    "rec2_j5_objective",
    f"""WITH {_MONTH_SQL}
SELECT dataset_id, CAST(i AS INTEGER) AS model_id, {r('phi')} AS phi,
       {r('(pow(10, ap) - 1) / ln(phi)')} AS term FROM weighted""",
)
def rec2_j5_objective(spark, sf):
    u, v, ratings = _month_factors(spark, sf)
    return rounded(factorize.objective(u, ratings, v), "phi", "term")


@query(
    "rec3_gradient_step",
    f"""WITH {_MONTH_SQL},
du AS (SELECT dataset_id, any_value(u) AS u, sum(w * r1) AS g1, sum(w * r2) AS g2
       FROM weighted GROUP BY dataset_id),
dv AS (SELECT i, sum(w * own * u[1]) AS g1, sum(w * own * u[2]) AS g2 FROM weighted GROUP BY i)
SELECT dataset_id AS id, unnest([0, 1])::INTEGER AS k,
       unnest([{r('u[1] - 0.1 * g1')}, {r('u[2] - 0.1 * g2')}]) AS value FROM du
UNION ALL
SELECT CAST(i AS VARCHAR), unnest([0, 1])::INTEGER, unnest([{r('g1')}, {r('g2')}]) FROM dv""",
)
def rec3_gradient_step(spark, sf):
    """Moved dataset factors at rate 0.1, and the summed gradients of the model factors."""
    u, v, ratings = _month_factors(spark, sf)
    step = factorize.gradient_step(u, ratings, factorize.factor_matrix(v), 0.1)
    moved = step.where("dataset_id IS NOT NULL").select(
        F.col("dataset_id").alias("id"), F.posexplode("vec").alias("k", "value")
    )
    grads = factorize.summed_gradient(step).select(
        F.col("model_id").cast("string").alias("id"), "k", F.col("grad").alias("value")
    )
    return rounded(moved.unionByName(grads), "value")


@query(
    "rec4_w5_stopping",
    f"""
WITH history AS (
  SELECT o_orderpriority AS run, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) AS INTEGER) AS iteration,
         valid_ndcg
  FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m,
               avg(o_totalprice) / 500000 AS valid_ndcg FROM orders GROUP BY ALL)),
gains AS (
  SELECT *, (valid_ndcg - lag(valid_ndcg) OVER w) / lag(valid_ndcg) OVER w AS gain
  FROM history WINDOW w AS (PARTITION BY run ORDER BY iteration)),
marked AS (
  SELECT *, CASE WHEN gain <= 0.001 THEN 1 ELSE 0 END AS flat,
         sum(CASE WHEN gain <= 0.001 THEN 0 ELSE 1 END)
           OVER (PARTITION BY run ORDER BY iteration) AS streak
  FROM gains),
counted AS (
  SELECT *, 1 + sum(flat) OVER (PARTITION BY run, streak ORDER BY iteration) AS stalled FROM marked),
cycle AS (SELECT [0.1, 0.1 + 0.8 / 7, 0.1 + 1.6 / 7, 0.1 + 2.4 / 7, 0.1 + 3.2 / 7, 0.1 + 4.0 / 7,
                  0.1 + 4.8 / 7, 0.9] AS up),
stops AS (SELECT run, min(iteration) FILTER (WHERE stalled > 3) AS stop FROM counted GROUP BY run)
SELECT run, iteration, {r('valid_ndcg')} AS valid_ndcg, {r('gain')} AS gain,
       CAST(stalled AS INTEGER) AS stalled,
       {r('list_concat(up, list_reverse(up))[CAST((iteration - 1) % 16 + 1 AS INTEGER)]')} AS rate,
       coalesce(iteration <= stop, true) AS trained
FROM counted JOIN stops USING (run), cycle""",
)
def rec4_w5_stopping(spark, sf):
    """Monthly average prices as a training history: learning rates, gains and the stopping rule."""
    from pyspark.sql import Window

    month = F.date_trunc("month", "o_orderdate")
    series = x.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("run"), month.alias("m")
    ).agg((F.avg("o_totalprice") / 500000).alias("valid_ndcg"))
    order = F.row_number().over(Window.partitionBy("run").orderBy("m"))
    history = series.select("run", order.alias("iteration"), "valid_ndcg")
    out = stopping_history(history, 0.1, 0.9, 8, patience=3)
    return rounded(out, "valid_ndcg", "gain", "rate")


@query("mat9_forests")
def mat9_forests(spark, sf):
    """Factors predicted from factors by forests, against the values they were fitted to."""
    vectors = meta_vectors(transform.zero_filled(x.supplier_meta(spark, sf)))
    inputs = factorize.embed(vectors, factorize.fit_embedding(vectors, 3), "x")
    forests = factorize.fit_forests(inputs, inputs.withColumnRenamed("x", "u"), 3, trees=20, depth=6)
    return factorize.predict_forests(inputs, forests)


def _supplier_training(spark, sf):
    # a row per supplier and column or model; written once, so the line items are read once for each
    meta = durable(x.supplier_meta(spark, sf))
    ranges = transform.min_max_fit(meta)
    vectors = durable(meta_vectors(transform.zero_filled(transform.min_max_apply(meta, ranges))))
    ids = vectors.select("dataset_id")
    performance = durable(complete_performance(durable(x.performance(spark, sf)), ids))
    split = transform.split_datasets(ids).persist()
    train = split.where("split = 'train'").select("dataset_id")
    valid = split.where("split = 'valid'").select("dataset_id")
    return (
        vectors.join(train, "dataset_id"),
        performance.join(train, "dataset_id"),
        vectors.join(valid, "dataset_id"),
        performance.join(valid, "dataset_id"),
    )


@query("rec5_train_history")
def rec5_train_history(spark, sf):
    model = factorize.train(
        *_supplier_training(spark, sf), factors=3, iterations=2, trees=5, depth=5,
        min_rate=0.1, max_rate=0.9, n_steps=8, batch_fraction=0.5,
    )
    return spark.createDataFrame(model.history)


@query("rec6_predict")
def rec6_predict(spark, sf):
    train, train_ap, valid, valid_ap = _supplier_training(spark, sf)
    model = factorize.train(
        train, train_ap, valid, valid_ap, factors=3, iterations=1, trees=5, depth=5,
        batch_fraction=1.0,
    )
    return model.predict(valid)


@query(
    "rec7_rank_from_factors",
    f"""WITH {_FACTORS_SQL}, {CATALOG},
mean AS (
  SELECT dataset_id, model_id, {r('avg(s)')} AS score
  FROM (SELECT dataset_id, model_id, list_dot_product(u, v) AS s FROM u, v
        UNION ALL SELECT dataset_id, model_id, list_dot_product(u, list_reverse(v)) FROM u, v)
  GROUP BY dataset_id, model_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, model_id DESC) AS k
  FROM mean)
SELECT dataset_id, CAST(k AS INTEGER) AS rank, model_id, name, score
FROM ranked JOIN models USING (model_id) WHERE k <= 5""",
)
def rec7_rank_from_factors(spark, sf):
    """Two sets of model factors, averaged, ranked and named."""
    u, v = _dataset_factors(spark, sf), _model_factors(spark, sf)
    both = factorize.score_models(u, v).unionByName(
        factorize.score_models(u, v.withColumn("v", F.reverse("v")))
    )
    mean = rounded(ensemble_mean(both), "score")
    return named_ranking(top_models(mean, 5), model_catalog(spark))


@query("rec7_recommend")
def rec7_recommend(spark, sf):
    """End to end: profile the line items of every nation's suppliers, learn, recommend 100 models."""
    supplier = x.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    items = x.table(spark, sf, "lineitem").join(supplier, "l_suppkey")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    shaped = samples(
        items, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        F.concat(F.lit("N"), "s_nationkey"), key,
    )
    meta = profile(shaped).persist()
    table = items.groupBy(
        F.concat(F.lit("N"), "s_nationkey").alias("dataset_id"),
        F.pmod("l_partkey", F.lit(302)).cast("int").alias("model_id"),
    ).agg((F.avg("l_discount") * 10).alias("ap"))
    fitted = fit_recommender(
        meta, table, model_catalog(spark), seeds=(0, 2), factors=3, iterations=1, trees=5,
        depth=5, batch_fraction=1.0,
    )
    return fitted.recommend_profiled(meta, 100)


@query(
    "rec9_similar_datasets",
    f"""WITH {x.SUPPLIER_META},
scaled AS (
  SELECT dataset_id, idx, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS value
  FROM meta WINDOW w AS (PARTITION BY idx)),
vectors AS (SELECT dataset_id, list(value ORDER BY idx) AS f FROM scaled GROUP BY dataset_id),
pairs AS (
  SELECT a.dataset_id, b.dataset_id AS similar_id, list_distance(a.f, b.f) AS distance,
         list_cosine_similarity(a.f, b.f) AS cosine
  FROM vectors a JOIN vectors b ON a.dataset_id <> b.dataset_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY distance) AS k FROM pairs)
SELECT dataset_id, similar_id, CAST(k AS INTEGER) AS rank, {rs('distance', 'cosine')}
FROM ranked WHERE k <= 3""",
)
def rec9_similar_datasets(spark, sf):
    meta = x.supplier_meta(spark, sf)
    scaled = transform.min_max_apply(meta, transform.min_max_fit(meta))
    return rounded(similar_datasets(meta_vectors(scaled), 3), "distance", "cosine")
