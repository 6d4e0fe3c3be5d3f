"""Datasets as ``samples(dataset_id, row_id, features, label)`` and ``cells``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strayfinder.functions.scalar import recode_label
from strayfinder.session import sized

# Substrings of a path whose ARFF file keeps the label in the second-last column (fixed values).
LABEL_SECOND_LAST = ("Arrhythmia", "Cardiotocography", "Hepatitis", "ALOI", "KDDCup99")
# Leading columns of a benchmark CSV that are not features.
CSV_LEADING = 6


def samples(
    df: DataFrame,
    features: Sequence[str | Column],
    dataset: Column,
    row_id: Column | None = None,
    label: Column | None = None,
) -> DataFrame:
    """Shape any table as samples; NULL features stay NULL for validation to find."""
    columns = [F.col(f) if isinstance(f, str) else f for f in features]
    out = [dataset.cast("string").alias("dataset_id")]
    if row_id is not None:
        out.append(row_id.cast("bigint").alias("row_id"))
    # adding 0.0 turns -0.0 into 0.0, so equal values group together everywhere
    out.append(F.array(*[c.cast("double") + F.lit(0.0) for c in columns]).alias("features"))
    if label is not None:
        out.append(label.cast("int").alias("label"))
    return df.select(*out)


def cells(sample_df: DataFrame) -> DataFrame:
    """One row per value: (dataset_id, [row_id], f_idx, value)."""
    keep = [c for c in ("dataset_id", "row_id") if c in sample_df.columns]
    return sample_df.select(*keep, F.posexplode("features").alias("f_idx", "value"))


def union_samples(*parts: DataFrame) -> DataFrame:
    """Stack sources by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def validation(sample_df: DataFrame) -> DataFrame:
    """Per dataset: rows, narrowest and widest row, and cells that are missing or infinite."""
    bad = F.aggregate(
        "features",
        F.lit(0),
        lambda n, x: n
        + F.when(
            x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(1)
        ).otherwise(F.lit(0)),
    )
    return sample_df.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.coalesce(F.size("features"), F.lit(0))).alias("min_width"),
        F.max(F.coalesce(F.size("features"), F.lit(0))).alias("max_width"),
        F.sum(bad.cast("bigint")).alias("bad_cells"),
    )


def validate(sample_df: DataFrame, width: int | None = None) -> DataFrame:
    """Raise when a dataset is ragged, has non-finite cells, or not the expected width."""
    report = validation(sample_df)
    wrong = (F.col("min_width") != F.col("max_width")) | (F.col("bad_cells") > 0)
    wrong = wrong | (F.col("min_width") < 1)
    if width is not None:
        wrong = wrong | (F.col("max_width") != width)
    first = report.where(wrong).orderBy("dataset_id").limit(3).collect()
    if first:
        raise ValueError(f"invalid datasets: {[r.asDict() for r in first]}")
    return sample_df


def label_report(sample_df: DataFrame) -> DataFrame:
    """Per dataset: rows, positive labels, and labels that are neither 0 nor 1 (missing ones too)."""
    known = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return sample_df.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(~known).alias("bad_labels"),
    )


def validate_labels(sample_df: DataFrame) -> DataFrame:
    """Raise when a label is neither 0 nor 1."""
    bad = label_report(sample_df).where("bad_labels > 0").orderBy("dataset_id").limit(3).collect()
    if bad:
        raise ValueError(f"label must be 0 or 1: {[r.asDict() for r in bad]}")
    return sample_df


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, path, row_id, head) of text files: ``head`` marks the first line of a file.

    Paths are decoded. ``row_id`` grows with the place in a file and differs between files. Large files
    are split, so a file's first line is the first row of the split that begins at its byte 0.
    """
    raw = spark.read.text(paths, recursiveFileLookup=True).select(
        F.trim(F.regexp_replace("value", "\r$", "")).alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    # one row per file: its paths and first lines are the bounded input of the scan
    first = (
        raw.where("_start = 0").groupBy(F.col("path").alias("_path")).agg(F.min("row_id").alias("_first"))
    )
    decoded = F.url_decode(F.regexp_replace("path", "\\+", "%2B"))
    return raw.join(sized(first), F.col("path") == F.col("_path"), "left").select(
        "line", decoded.alias("path"), "row_id", F.coalesce(F.col("row_id") == F.col("_first"), F.lit(False)).alias("head")
    )


def fields(line: Column) -> Column:
    """The values of a CSV line; commas inside double quotes don't split."""
    quoted = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    parts = F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))
    return F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r'^\s*"|"\s*$', "")))


def _numbers(parts: Column, start: int, drop_last: int = 0) -> Column:
    """Values from position ``start`` as doubles; text that is no number is NULL."""
    width = F.greatest(F.size(parts) - F.lit(start + drop_last), F.lit(0))
    return F.transform(F.slice(parts, F.lit(start + 1), width), lambda x: x.try_cast("double") + F.lit(0.0))


def read_arff(
    spark: SparkSession,
    path: str,
    second_last: Sequence[str] = LABEL_SECOND_LAST,
    dataset_pattern: str = r"([^/]+)\.arff$",
    check_labels: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(samples, attributes) of a directory of ARFF files, one dataset per match in the path.

    The last two columns hold an id and the label; which of them is the label depends on the path.
    Files are split line by line, so a large file is read by many tasks. A label that is neither 0 nor
    1 raises, unless ``check_labels`` is off; then it is NULL or what it is.
    """
    lines = text_lines(spark, path).withColumn("dataset_id", F.regexp_extract("path", dataset_pattern, 1))
    attributes = lines.where(F.lower("line").startswith("@attribute")).select(
        "dataset_id",
        F.regexp_extract("line", r"(?i)^@attribute\s+('[^']*'|\"[^\"]*\"|\S+)", 1).alias("name"),
        F.regexp_extract(
            "line", r"(?i)^@attribute\s+(?:'[^']*'|\"[^\"]*\"|\S+)\s+(.*)$", 1
        ).alias("type"),
    )
    moved = F.lit(False)
    for name in second_last:
        moved = moved | F.col("path").contains(name)
    parts = F.split("line", r"\s*,\s*")
    # get() instead of element_at(): Spark may move these expressions before the header filter
    size = F.size(parts)
    text = F.regexp_replace(F.get(parts, size - F.when(moved, 2).otherwise(1)), "['\"]", "")
    label = recode_label(text)
    if check_labels:
        wrong = F.concat(F.lit("label must be 0 or 1: "), F.coalesce(text, F.lit("none")), F.lit(" in "), "path")
        label = F.when(label.isin(0, 1), label).otherwise(F.raise_error(wrong).cast("int"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[@%]"))
    return (
        rows.select("dataset_id", "row_id", _numbers(parts, 0, 2).alias("features"), label.alias("label")),
        attributes,
    )


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    skip: int = CSV_LEADING,
    dataset_pattern: str = r"([^/]+?)(?:\.csv)?$",
) -> DataFrame:
    """Samples from CSV files whose first line is a header: columns from ``skip`` on are the features.

    Every file has its own width; the header is known by its place, so a line without a number stays,
    with NULL features for validation to find. Quoted fields may hold commas but no line breaks.
    """
    rows = text_lines(spark, paths).where("not head and line <> ''")
    return rows.select(
        F.regexp_extract("path", dataset_pattern, 1).alias("dataset_id"),
        "row_id",
        _numbers(fields(F.col("line")), skip).alias("features"),
    )


def read_manifest(spark: SparkSession, manifest: str, root: str, skip: int = CSV_LEADING):
    """Samples of every file a manifest lists; ``bench.id`` names the dataset.

    A location is a file or a folder below ``root``. A file that no location names raises.
    """
    listed = spark.read.csv(manifest, header=True).select(
        F.col("`bench.id`").alias("dataset_id"),
        F.col("location").alias("location"),
    )
    # a manifest lists files or folders, not rows: its paths are the bounded input of the scan
    paths = [f"{root.rstrip('/')}/{r.location}" for r in listed.select("location").toLocalIterator()]
    rows = text_lines(spark, paths).where("not head and line <> ''")
    relative = F.ltrim(F.substring_index("path", root.rstrip("/"), -1), F.lit("/"))
    folder = F.regexp_replace("_file", "/[^/]*$", "")
    trimmed = F.regexp_replace("location", "^/+|/+$", "")
    by_file = listed.select(trimmed.alias("_file"), F.col("dataset_id").alias("_by_file"))
    by_folder = listed.select(trimmed.alias("_folder"), F.col("dataset_id").alias("_by_folder"))
    unknown = F.raise_error(F.concat(F.lit("the manifest names no location of "), "path")).cast("string")
    return (
        rows.withColumn("_file", relative)
        .withColumn("_folder", folder)
        .join(sized(by_file), "_file", "left")
        .join(sized(by_folder), "_folder", "left")
        .select(
            F.coalesce("_by_file", "_by_folder", unknown).alias("dataset_id"),
            "row_id",
            _numbers(fields(F.col("line")), skip).alias("features"),
        )
    )


def performance_long(
    table: DataFrame, models: Sequence[str], dataset: str = "dataset_id"
) -> DataFrame:
    """Wide performance table (one column per model) to (dataset_id, model, ap)."""
    wide = table.select(
        F.col(f"`{dataset}`").cast("string").alias("dataset_id"),
        *[F.col(f"`{m}`").try_cast("double").alias(m) for m in models],
    )
    return wide.unpivot("dataset_id", [F.col(f"`{m}`") for m in models], "model", "ap")


def read_performance(
    spark: SparkSession, path: str, leading: int = 4, skip_rows: int = 2
) -> DataFrame:
    """Performance CSV: first column names the dataset, columns from ``leading`` on are models.

    The ``skip_rows`` lines after the header carry no results; they are recognised by position in
    the file, so the table must be one file (it has one line per dataset).
    """
    table = spark.read.csv(path, header=True)
    models = table.columns[leading:]
    if skip_rows:
        table = (
            table.withColumn("_line", F.monotonically_increasing_id())
            .where(F.col("_line") >= skip_rows)
            .drop("_line")
        )
    return performance_long(table, models, table.columns[0])
