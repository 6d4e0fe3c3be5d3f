"""The 200 meta-features of every dataset, as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strayfinder.functions.scalar import SUMMARY_PARTS, clean
from strayfinder.operators import hbos, iforest, loda, pairs, per_feature, pooled, spectral
from strayfinder.session import batches_by_rows, durable, fold_together, sized


def _summary_names(*blocks: str) -> list[str]:
    return [f"{b}_{part}" for b in blocks for part in SUMMARY_PARTS]


# Names in vector order; the position of a name is its index.
META_NAMES: tuple[str, ...] = (
    *pooled.POOLED_NAMES,
    *_summary_names("normality_p", "is_normal_5", "is_normal_1"),
    *_summary_names(*[f"moment_{k}" for k in per_feature.MOMENT_ORDERS]),
    *_summary_names("skewness", "kurtosis", "correlation", "covariance", "sparsity"),
    *_summary_names("anova_p_value"),
    *spectral.FIRST_ROW_NAMES,
    *_summary_names("entropy", "HBOS_mean", "HBOS_max", "HBOS_min"),
    *_summary_names(*iforest.IFOREST_BLOCKS),
    *spectral.SPECTRAL_NAMES,
    *_summary_names("LODA_n_hists_mean", "LODA_n_hists_max", "LODA_n_cuts_mean", "LODA_n_cuts_max"),
)
META_WIDTH = 200


def to_long(wide: DataFrame) -> DataFrame:
    """(dataset_id, name, value) of the meta-feature columns a wide table has."""
    entries = [
        F.struct(F.lit(name).alias("name"), clean(F.col(name).cast("double")).alias("value"))
        for name in META_NAMES
        if name in wide.columns
    ]
    return wide.select("dataset_id", F.inline(F.array(*entries)))


def indexed(long: DataFrame) -> DataFrame:
    """meta(dataset_id, idx, name, value): positions in the vector looked up by name."""
    names = long.sparkSession.createDataFrame(list(enumerate(META_NAMES)), "idx int, name string")
    return long.join(F.broadcast(names), "name").select("dataset_id", "idx", "name", "value")


def statistics(
    sample_df: DataFrame,
    quantile_scale: float = 0.01,
    base: DataFrame | None = None,
    products: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The meta-features that need neither a row id nor randomness, long."""
    # the only shuffle that grows with the data; every statistic of single features and all order
    # statistics read it
    if counts is None:
        counts = durable(pooled.value_counts(sample_df, outer=True))
    if base is None:
        base = sized(per_feature.feature_base(sample_df, counts))
    if products is None:
        with batches_by_rows(sample_df.sparkSession, _widest(base)):
            products = durable(pairs.cross_products(sample_df, base))
    counts = counts.where(F.col("f_idx").isNotNull())
    stats = per_feature.feature_stats(sample_df, base, counts)
    parts = [
        to_long(
            pooled.pooled(sample_df, quantile_scale, pooled.merged_base(base), counts)
        ),
        per_feature.feature_summaries(stats),
        pairs.pair_summaries(pairs.pair_stats(products, base)),
        hbos.hbos_landmarks(hbos.histogram(sample_df, base, hbos.HBOS_BINS, counts)),
        to_long(spectral.pca_landmarks(spectral.eigen(products, base, scaled=True))),
    ]
    return indexed(_stack(parts))


def profile(sample_df: DataFrame, seed: int = 0, quantile_scale: float = 0.01) -> DataFrame:
    """All 200 meta-features of each dataset: ``meta(dataset_id, idx, name, value)``.

    One job set profiles one dataset or ten thousand. Undefined values are NULL rows, so every
    dataset has exactly 200 rows.
    """
    counts = durable(pooled.value_counts(sample_df, outer=True))
    base = per_feature.validate_base(sized(per_feature.feature_base(sample_df, counts)))
    sizes = base.groupBy("dataset_id").agg(F.max("n_rows").alias("n_rows"))
    # Python sees all rows three times, and leaves tables that don't grow with them
    with batches_by_rows(sample_df.sparkSession, _widest(base)):
        # p(p+1)/2 sums per dataset, read by the pair, spectral and first-row blocks
        products, reached = fold_together(
            sample_df.select("dataset_id", "features"),
            [pairs.product_fold(base), loda.range_fold(seed=seed)],
        )
        products = durable(pairs.summed_products(products))
        first_rows, counted = fold_together(
            sample_df.select("dataset_id", "row_id", "features"),
            [
                spectral.first_row_fold(spectral.eigen(products, base)),
                loda.count_fold(sized(loda.cut_ranges(reached)), seed=seed),
            ],
        )
        forest = durable(iforest.iforest_fit(sample_df, seed=seed, counts=sizes))
    parts = [
        spectral.first_row_summary(first_rows),
        iforest.iforest_landmarks(forest),
        loda.loda_landmarks(loda.cut_histograms(counted)),
    ]
    known = statistics(sample_df, quantile_scale, base, products, counts).unionByName(
        indexed(_stack(parts))
    )
    names = F.array(*[F.lit(n) for n in META_NAMES])
    frame = base.select("dataset_id").distinct().select(
        "dataset_id", F.posexplode(names).alias("idx", "name")
    )
    return frame.join(known.drop("name"), ["dataset_id", "idx"], "left").select(
        "dataset_id", "idx", "name", "value"
    )


def _widest(base: DataFrame) -> int:
    return (base.agg(F.max("f_idx")).first()[0] or 0) + 1


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def meta_vectors(meta: DataFrame) -> DataFrame:
    """(dataset_id, features): values in index order, one bounded array per dataset."""
    packed = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return meta.groupBy("dataset_id").agg(packed.alias("_m")).select(
        "dataset_id", F.col("_m.value").alias("features")
    )
