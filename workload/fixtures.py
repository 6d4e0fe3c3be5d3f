"""Datasets made from the test tables: a Spark side and the equal SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfinder.sources.datasets import samples


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------------------- samples


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Six datasets, four features, no row id."""
    return samples(
        table(spark, sf, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        F.concat("l_returnflag", "l_linestatus"),
    )


LINEITEM = """samples AS (
  SELECT l_returnflag || l_linestatus AS dataset_id,
         [l_quantity + 0.0, l_extendedprice + 0.0, l_discount + 0.0, l_tax + 0.0] AS features
  FROM lineitem)"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset, 64 features."""
    return table(spark, sf, "embeddings").select(
        F.lit("embeddings").alias("dataset_id"),
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


EMBEDDINGS = """samples AS (
  SELECT 'embeddings' AS dataset_id, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Five datasets, three features of which one has heavy tails."""
    return samples(
        table(spark, sf, "events"),
        ["value", F.hour("ts"), F.dayofmonth("ts")],
        F.col("event_type"),
        F.col("event_id"),
    )


EVENTS = """samples AS (
  SELECT event_type AS dataset_id, event_id AS row_id,
         [value + 0.0, hour(ts) + 0.0, dayofmonth(ts) + 0.0]::DOUBLE[] AS features
  FROM events)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset per language; label 1 for toxic documents, NULL where unlabelled."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    words = F.size(F.split("text", " "))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return samples(
        docs, ["n_chars", words, lines], F.col("lang"), F.col("doc_id"), F.col("toxic")
    )


DOCUMENTS = """samples AS (
  SELECT lang AS dataset_id, doc_id AS row_id,
         [n_chars + 0.0, len(string_split(text, ' ')) + 0.0,
          length(text) - length(replace(text, chr(10), '')) + 1.0]::DOUBLE[] AS features,
         toxic AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """One small dataset per brand, two features."""
    return samples(
        table(spark, sf, "part"), ["p_size", "p_retailprice"], F.col("p_brand"), F.col("p_partkey")
    )


PARTS = """samples AS (
  SELECT p_brand AS dataset_id, p_partkey AS row_id,
         [p_size + 0.0, p_retailprice + 0.0]::DOUBLE[] AS features
  FROM part)"""

CELLS = """cells AS (
  SELECT dataset_id, unnest(range(len(features))) AS f_idx, unnest(features) AS value FROM samples)"""
KEYED_CELLS = """cells AS (
  SELECT dataset_id, row_id, unnest(range(len(features))) AS f_idx, unnest(features) AS value
  FROM samples)"""


# ------------------------------------------------------------------------------- past results


def performance(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset_id, model_id, ap) with missing entries: suppliers are datasets, parts map to models."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("S"), "l_suppkey").alias("dataset_id"),
            F.pmod("l_partkey", F.lit(302)).cast("int").alias("model_id"),
        )
        .agg((F.avg("l_discount") * 10).alias("ap"))
    )


PERFORMANCE = """performance AS (
  SELECT 'S' || l_suppkey AS dataset_id, CAST(l_partkey % 302 AS INTEGER) AS model_id,
         avg(l_discount) * 10 AS ap
  FROM lineitem GROUP BY ALL)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A complete (dataset_id, model_id, ap): customer segments are datasets, months are models."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("dataset_id"),
            (F.month("o_orderdate") - 1).cast("int").alias("model_id"),
        )
        .agg((F.avg("o_totalprice") / 500000.0).alias("ap"))
    )


MONTHLY = """monthly AS (
  SELECT c_mktsegment || '/' || o_orderpriority AS dataset_id,
         CAST(month(o_orderdate) - 1 AS INTEGER) AS model_id, avg(o_totalprice) / 500000.0 AS ap
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def supplier_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Long meta-features (dataset_id, idx, value) of suppliers; 7 of the 200, two NULL-able."""
    from strayfinder.operators.pooled import pooled_base
    from strayfinder.plans.profile import indexed, to_long

    shaped = samples(
        table(spark, sf, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        F.concat(F.lit("S"), "l_suppkey"),
    )
    return indexed(to_long(pooled_base(shaped))).select("dataset_id", "idx", "value")


SUPPLIER_META = """wide_meta AS (
  SELECT dataset_id, count(*) FILTER (WHERE f_idx = 0) AS c0, max(f_idx) + 1 AS c1,
         avg(value) AS c2, var_pop(value) AS c4, min(value) AS c5, max(value) AS c6,
         stddev_pop(value) AS c7
  FROM (SELECT 'S' || l_suppkey AS dataset_id, unnest([0, 1, 2, 3]) AS f_idx,
               unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)
  GROUP BY dataset_id),
meta AS (
  SELECT dataset_id, unnest([0, 1, 2, 4, 5, 6, 7]) AS idx,
         unnest([c0, c1, c2, c4, c5, c6, c7]::DOUBLE[]) AS value FROM wide_meta)"""


def with_gaps(meta: DataFrame) -> DataFrame:
    """Meta-features where negative or tiny minima count as missing (both engines agree on it)."""
    return meta.withColumn(
        "value", F.when(~((F.col("idx") == 0) & (F.col("value") > 600)), F.col("value"))
    )


WITH_GAPS = """gaps AS (
  SELECT dataset_id, idx, CASE WHEN NOT (idx = 0 AND value > 600) THEN value END AS value
  FROM meta)"""
