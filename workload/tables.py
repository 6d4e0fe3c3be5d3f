"""Sources, projections, joins, set operations and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strayfinder.functions.scalar import (
    dot,
    flag,
    gain,
    recode_label,
    sigmoid,
    sigmoid_derivative,
)
from strayfinder.operators import transform
from strayfinder.operators.ranking import top_models
from strayfinder.session import checkpoint_folder
from strayfinder.sources import catalog
from strayfinder.sources.artifacts import load_tables, save_tables
from strayfinder.sources.datasets import (
    cells,
    label_report,
    performance_long,
    read_arff,
    read_csv,
    read_manifest,
    samples,
    union_samples,
)
from workload import fixtures as x
from workload.registry import digits, query, r, rounded, rs


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------- sources

_EVENT_SET = "CASE WHEN event_type = 'error' THEN 'ALOI-error' ELSE event_type END"


@query(
    "src1_arff",
    f"""
SELECT {_EVENT_SET} AS dataset_id, {r('value')} AS f0, {r('hour(ts)')} AS f1,
       CAST(event_id % 2 AS INTEGER) AS label, count(*) AS c
FROM events GROUP BY ALL""",
)
def src1_arff(spark, sf):
    """Events written as ARFF files and read back; one dataset keeps its label second to last."""
    found, _ = read_arff(spark, _write_arff(spark, sf), dataset_pattern=r"dataset=([^/]+)/")
    out = found.select(
        "dataset_id",
        digits(F.col("features")[0]).alias("f0"),
        digits(F.col("features")[1]).alias("f1"),
        "label",
    )
    return out.groupBy("dataset_id", "f0", "f1", "label").agg(F.count(F.lit(1)).alias("c"))


def _write_arff(spark, sf) -> str:
    events = x.table(spark, sf, "events").withColumn("dataset", F.expr(_EVENT_SET))
    label = F.when(F.col("event_id") % 2 == 1, "'yes'").otherwise("'no'")
    tail = F.when(F.col("dataset") == "ALOI-error", F.concat_ws(",", label, "event_id")).otherwise(
        F.concat_ws(",", "event_id", label)
    )
    rows = events.select("dataset", F.concat_ws(", ", "value", F.hour("ts"), tail).alias("value"))
    head = events.select("dataset").distinct().select(
        "dataset",
        F.explode(
            F.array(*[F.lit(t) for t in (
                "% comment", "@relation events", "@attribute value numeric",
                "@attribute 'hour' numeric", "@attribute id numeric",
                "@attribute outlier {'yes','no'}", "@data",
            )])
        ).alias("value"),
    )
    folder = _folder(spark)
    rows.unionByName(head).write.partitionBy("dataset").text(folder)
    return folder


def _cells_sql(table: str, dataset: str, values: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""
SELECT {dataset} AS dataset_id, {i} AS f_idx, count({v}) AS n, {r(f'sum(CAST({v} AS DOUBLE))')} AS total,
       {r(f'min({v})')} AS least, {r(f'max({v})')} AS most FROM {table} GROUP BY ALL"""
        for i, v in enumerate(values)
    )


def _cell_sums(found):
    """The read-back rows exploded to cells, as profiles use them."""
    value = F.col("value")
    return (
        cells(found)
        .groupBy("dataset_id", "f_idx")
        .agg(
            F.count(value).alias("n"), digits(F.sum(value)).alias("total"),
            digits(F.min(value)).alias("least"), digits(F.max(value)).alias("most"),
        )
    )


_CSV_SQL = f"""
SELECT c_mktsegment AS dataset_id, {r('c_acctbal')} AS f0, {r('c_nationkey')} AS f1, count(*) AS c
FROM customer GROUP BY ALL"""


def _write_csv(spark, sf) -> str:
    folder = _folder(spark)
    customer = x.table(spark, sf, "customer")
    customer.select(
        "c_mktsegment", "c_custkey", F.lit("a").alias("m1"), F.lit("b").alias("m2"),
        F.lit("c").alias("m3"), F.lit("d").alias("m4"), F.lit("e").alias("m5"),
        "c_acctbal", "c_nationkey",
    ).write.partitionBy("c_mktsegment").csv(folder, header=True)
    return folder


def _counted(found):
    out = found.select(
        "dataset_id",
        digits(F.col("features")[0]).alias("f0"),
        digits(F.col("features")[1]).alias("f1"),
    )
    return out.groupBy("dataset_id", "f0", "f1").agg(F.count(F.lit(1)).alias("c"))


@query(
    "agg7_label_report",
    """
SELECT l_returnflag || l_linestatus AS dataset_id, count(*) AS n_rows,
       count(*) FILTER (l_linenumber - 1 = 1) AS positives,
       count(*) FILTER (l_linenumber - 1 NOT IN (0, 1)) AS bad_labels
FROM lineitem GROUP BY ALL""",
)
def agg7_label_report(spark, sf):
    """The expectation behind the label check, over labels of which most are wrong."""
    shaped = samples(
        x.table(spark, sf, "lineitem"), ["l_quantity"], F.concat("l_returnflag", "l_linestatus"),
        label=F.col("l_linenumber") - 1,
    )
    return label_report(shaped)


@query(
    "sink1_src6_roundtrip",
    f"""
SELECT event_type AS dataset_id, hour(ts)::INTEGER AS f_idx, count(*) AS n, {r('avg(value)')} AS mean
FROM events GROUP BY ALL""",
)
def sink1_src6_roundtrip(spark, sf):
    """Fitted statistics saved to shared storage and loaded again, arrays and all."""
    fitted = (
        x.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("dataset_id"), F.hour("ts").alias("f_idx"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        .groupBy("dataset_id")
        .agg(F.collect_list(F.struct("f_idx", "n", "mean")).alias("stats"))
    )
    folder = _folder(spark)
    save_tables(folder, fitted=fitted)
    loaded = load_tables(spark, folder, "fitted")["fitted"]
    return rounded(loaded.select("dataset_id", F.inline("stats")), "mean")


@query("src1_arff_cells", _cells_sql("events", _EVENT_SET, ("value", "hour(ts)")))
def src1_arff_cells(spark, sf):
    found, _ = read_arff(spark, _write_arff(spark, sf), dataset_pattern=r"dataset=([^/]+)/")
    return _cell_sums(found)


@query("src2_csv_cells", _cells_sql("customer", "c_mktsegment", ("c_acctbal", "c_nationkey")))
def src2_csv_cells(spark, sf):
    pattern = r"c_mktsegment=([^/]+)/"
    return _cell_sums(read_csv(spark, f"{_write_csv(spark, sf)}/*", dataset_pattern=pattern))


@query("src3_manifest_cells", _cells_sql("customer", "c_mktsegment", ("c_acctbal", "c_nationkey")))
def src3_manifest_cells(spark, sf):
    return _cell_sums(read_manifest(spark, *_listed(spark, sf)))


@query("src2_csv", _CSV_SQL)
def src2_csv(spark, sf):
    """Customers written as CSV with six leading columns, one folder per dataset, and read back."""
    return _counted(
        read_csv(
            spark, f"{_write_csv(spark, sf)}/*", dataset_pattern=r"c_mktsegment=([^/]+)/"
        )
    )


@query("src3_manifest", _CSV_SQL)
def src3_manifest(spark, sf):
    """The same files found through a manifest of locations."""
    return _counted(read_manifest(spark, *_listed(spark, sf)))


def _listed(spark, sf) -> tuple[str, str]:
    """A manifest of the CSV folders, and their root."""
    root = _write_csv(spark, sf)
    segments = x.table(spark, sf, "customer").select("c_mktsegment").distinct()
    manifest = _folder(spark)
    segments.select(
        F.col("c_mktsegment").alias("bench.id"),
        F.concat(F.lit("c_mktsegment="), "c_mktsegment").alias("location"),
    ).write.csv(manifest, header=True)
    return manifest, root


@query(
    "src4_performance_long",
    f"""
WITH wide AS (
  SELECT o_orderpriority AS dataset_id, avg(o_totalprice) AS m0, min(o_totalprice) AS m1,
         CASE WHEN count(*) > 2990 THEN max(o_totalprice) END AS m2
  FROM orders GROUP BY o_orderpriority)
SELECT dataset_id, unnest(['m0', 'm1', 'm2']) AS model,
       unnest([{r('m0')}, {r('m1')}, {r('m2')}]) AS ap FROM wide""",
)
def src4_performance_long(spark, sf):
    wide = (
        x.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("dataset_id"))
        .agg(
            F.avg("o_totalprice").alias("m0"),
            F.min("o_totalprice").alias("m1"),
            F.when(F.count(F.lit(1)) > 2990, F.max("o_totalprice")).alias("m2"),
        )
    )
    return rounded(performance_long(wide, ["m0", "m1", "m2"]), "ap")


CATALOG = "catalog AS (" + " UNION ALL ".join(
    f"""
  SELECT family, position, '{family}(' || {" || ', ' || ".join(f"'{k}=' || {k}" for k in sorted(grid))} || ')' AS name
  FROM (SELECT '{family}' AS family, {order} * 100000 + {' + '.join(
      f"list_position({[str(v) for v in values]}, {k}) * {100 ** (len(grid) - 1 - i)}"
      for i, (k, values) in enumerate(grid.items()))} AS position, *
        FROM {', '.join(f"(SELECT unnest({[str(v) for v in values]}) AS {k})" for k, values in grid.items())})"""
    for order, (family, grid) in enumerate(catalog.GRIDS)
) + "), models AS (SELECT CAST(row_number() OVER (ORDER BY position) - 1 AS INTEGER) AS model_id, name, family FROM catalog)"


@query(
    "j2_src7_model_names",
    f"""
WITH {x.PERFORMANCE}, {CATALOG},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {r('ap')} DESC, model_id DESC) AS rank
  FROM performance)
SELECT dataset_id, model_id, name, family, {r('ap')} AS score, CAST(rank AS INTEGER) AS rank
FROM ranked JOIN models USING (model_id) WHERE rank <= 10""",
)
def j2_src7_model_names(spark, sf):
    scores = x.performance(spark, sf).withColumnRenamed("ap", "score")
    best = top_models(rounded(scores, "score"), 10)
    names = catalog.model_catalog(spark).select("model_id", "name", "family")
    return best.join(F.broadcast(names), "model_id").select(
        "dataset_id", "model_id", "name", "family", "score", "rank"
    )


@query(
    "src7_catalog_coverage",
    f"""
WITH {x.PERFORMANCE}, {CATALOG}
SELECT model_id, name, family, count(ap) AS n_results
FROM models LEFT JOIN performance USING (model_id) GROUP BY model_id, name, family""",
)
def src7_catalog_coverage(spark, sf):
    """Every model of the catalogue with the number of results the performance table holds."""
    counts = x.performance(spark, sf).groupBy("model_id").agg(F.count("ap").alias("n"))
    return catalog.model_catalog(spark).join(counts, "model_id", "left").select(
        "model_id", "name", "family", F.coalesce("n", F.lit(0)).alias("n_results")
    )


# ------------------------------------------------------------------------------- projections


@query(
    "pf1_pf2_slice_cast",
    f"""
SELECT event_id, {r("TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)")} AS k,
       {r('value')} AS first, {r('dayofmonth(ts)')} AS last,
       CAST(TRY_CAST(event_type AS INTEGER) AS INTEGER) AS not_a_number
FROM events""",
)
def pf1_pf2_slice_cast(spark, sf):
    parts = F.split(
        F.concat_ws(",", "event_id", F.regexp_extract("props", "[0-9]+", 0), "value",
                    F.hour("ts"), F.dayofmonth("ts")),
        ",",
    )
    events = x.table(spark, sf, "events").withColumn("_p", parts)
    features = F.transform(F.slice("_p", 2, 4), lambda v: v.try_cast("double"))
    return events.select(
        "event_id",
        digits(features[0]).alias("k"),
        digits(features[1]).alias("first"),
        digits(F.element_at(features, -1)).alias("last"),
        F.col("event_type").try_cast("int").alias("not_a_number"),
    )


@query(
    "pf3_agg7_labels",
    """
SELECT lang AS dataset_id, toxic AS label, count(*) AS c
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def pf3_agg7_labels(spark, sf):
    docs = x.table(spark, sf, "documents").join(x.table(spark, sf, "labels"), "doc_id", "left")
    text = F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "no")
    return docs.groupBy(
        F.col("lang").alias("dataset_id"), recode_label(text).alias("label")
    ).agg(F.count(F.lit(1)).alias("c"))


@query(
    "pf7_threshold_flags",
    """
SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_tax < 0.05 AS INTEGER)) AS BIGINT) AS below_5,
       CAST(sum(CAST(l_tax < 0.01 AS INTEGER)) AS BIGINT) AS below_1
FROM lineitem GROUP BY l_suppkey""",
)
def pf7_threshold_flags(spark, sf):
    return x.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag(F.col("l_tax") < 0.05)).alias("below_5"),
        F.sum(flag(F.col("l_tax") < 0.01)).alias("below_1"),
    )


# ------------------------------------------------------------------------------- functions


@query(
    "fn1_fn2_sigmoid",
    f"""
SELECT event_id, {r('1 / (1 + exp(-value / 10))')} AS s,
       {r('1 / (1 + exp(-2 * value / 10)) * (1 - 1 / (1 + exp(-2 * value / 10)))')} AS ds
FROM events""",
)
def fn1_fn2_sigmoid(spark, sf):
    v = F.col("value") / 10
    return x.table(spark, sf, "events").select(
        "event_id",
        digits(sigmoid(v)).alias("s"),
        digits(sigmoid_derivative(v, 2.0)).alias("ds"),
    )


@query(
    "fn4_gain",
    f"""WITH {x.PERFORMANCE}
SELECT dataset_id, {r('sum(pow(10, ap) - 1)')} AS gain FROM performance GROUP BY dataset_id""",
)
def fn4_gain(spark, sf):
    out = x.performance(spark, sf).groupBy("dataset_id").agg(F.sum(gain(F.col("ap"))).alias("gain"))
    return rounded(out, "gain")


@query(
    "fn6_dot",
    f"""
SELECT vec_id, {r('list_dot_product(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[])))')} AS d
FROM embeddings""",
)
def fn6_dot(spark, sf):
    e = x.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", digits(dot(F.col("v"), F.reverse("v"))).alias("d"))


# ------------------------------------------------------------------------------- sets


@query(
    "set1_difference",
    """
SELECT c_nationkey AS key FROM customer WHERE c_acctbal < 0
EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""",
)
def set1_difference(spark, sf):
    left = x.table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_nationkey").alias("key")
    )
    right = x.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return transform.difference(left, right)


@query(
    "set2_union_sources",
    f"""
SELECT dataset_id, count(*) AS n, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std FROM (
  SELECT 'customer' AS dataset_id, c_acctbal AS v FROM customer
  UNION ALL SELECT 'supplier', s_acctbal FROM supplier
  UNION ALL SELECT 'part', p_retailprice FROM part) GROUP BY dataset_id""",
)
def set2_union_sources(spark, sf):
    from strayfinder.operators.per_feature import feature_base

    both = union_samples(
        samples(x.table(spark, sf, "customer"), ["c_acctbal"], F.lit("customer"), F.col("c_custkey")),
        samples(x.table(spark, sf, "supplier"), ["s_acctbal"], F.lit("supplier"), F.col("s_suppkey")),
        samples(x.table(spark, sf, "part"), ["p_retailprice"], F.lit("part")),
    )
    return rounded(feature_base(both).select("dataset_id", "n", "mean", "std"), "mean", "std")


# ------------------------------------------------------------------------------- transforms


@query(
    "mat2_standardise",
    f"""WITH {x.EMBEDDINGS}, {x.KEYED_CELLS},
m AS (SELECT f_idx, avg(value) AS mean, stddev_pop(value) AS std FROM cells GROUP BY f_idx)
SELECT row_id, CAST(f_idx AS INTEGER) AS f_idx, {r('(value - mean) / std')} AS value
FROM cells JOIN m USING (f_idx)""",
)
def mat2_standardise(spark, sf):
    from strayfinder.sources.datasets import cells

    cell = cells(x.embeddings(spark, sf)).select("row_id", "f_idx", "value")
    out = transform.standard_apply(cell, transform.standard_fit(cell, "f_idx"), "f_idx")
    return rounded(out.select("row_id", "f_idx", "value"), "value")


@query(
    "mat3_agg6_mean_fill",
    f"""WITH {x.SUPPLIER_META}, {x.WITH_GAPS}
SELECT dataset_id, CAST(idx AS INTEGER) AS idx,
       {r('coalesce(value, avg(value) OVER (PARTITION BY idx))')} AS value FROM gaps""",
)
def mat3_agg6_mean_fill(spark, sf):
    filled = transform.mean_fill(x.with_gaps(x.supplier_meta(spark, sf)))
    return rounded(filled.select("dataset_id", "idx", "value"), "value")


@query(
    "mat4_min_max",
    f"""WITH {x.SUPPLIER_META}, {x.WITH_GAPS}
SELECT dataset_id, CAST(idx AS INTEGER) AS idx,
       {r('CASE WHEN value IS NOT NULL THEN coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) END')} AS value
FROM gaps WINDOW w AS (PARTITION BY idx)""",
)
def mat4_min_max(spark, sf):
    meta = x.with_gaps(x.supplier_meta(spark, sf))
    scaled = transform.min_max_apply(meta, transform.min_max_fit(meta))
    return rounded(scaled.select("dataset_id", "idx", "value"), "value")


@query(
    "mat5_j6_split",
    """
WITH ids AS (SELECT DISTINCT 'S' || l_suppkey AS dataset_id FROM lineitem),
h AS (SELECT dataset_id, row_number() OVER (ORDER BY md5('0:' || dataset_id), dataset_id) AS k,
             count(*) OVER () AS n FROM ids)
SELECT dataset_id, CASE WHEN k <= floor(0.85 * n) THEN 'train' ELSE 'valid' END AS split FROM h""",
)
def mat5_j6_split(spark, sf):
    ids = x.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("dataset_id")
    )
    return transform.split_datasets(ids)


@query(
    "j6_semi_anti",
    f"""WITH {x.PERFORMANCE},
ids AS (SELECT DISTINCT dataset_id FROM performance),
h AS (SELECT dataset_id, row_number() OVER (ORDER BY md5('7:' || dataset_id), dataset_id) AS k,
             count(*) OVER () AS n FROM ids)
SELECT CASE WHEN k <= floor(0.85 * n) THEN 'train' ELSE 'valid' END AS side, count(*) AS entries,
       {r('avg(ap)')} AS mean_ap
FROM performance JOIN h USING (dataset_id) GROUP BY side""",
)
def j6_semi_anti(spark, sf):
    table = x.performance(spark, sf)
    split = transform.split_datasets(table, seed=7).where("split = 'train'").persist()
    train = table.join(split, "dataset_id", "left_semi").withColumn("side", F.lit("train"))
    valid = table.join(split, "dataset_id", "left_anti").withColumn("side", F.lit("valid"))
    out = train.unionByName(valid).groupBy("side").agg(
        F.count(F.lit(1)).alias("entries"), F.avg("ap").alias("mean_ap")
    )
    return rounded(out, "mean_ap")


@query(
    "mat6_pf6_zero_fill",
    f"""WITH {x.SUPPLIER_META}, {x.WITH_GAPS}
SELECT dataset_id, CAST(idx AS INTEGER) AS idx, {r('coalesce(value, 0)')} AS value FROM gaps""",
)
def mat6_pf6_zero_fill(spark, sf):
    filled = transform.zero_filled(x.with_gaps(x.supplier_meta(spark, sf)))
    return rounded(filled.select("dataset_id", "idx", "value"), "value")
