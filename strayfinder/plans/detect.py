"""Run catalogue models on datasets, and build the performance table from labelled ones."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, functions as F

from strayfinder.operators import hbos, iforest, loda, neighbor_tables, neighbors, ocsvm
from strayfinder.operators.evaluate import average_precision
from strayfinder.session import durable, sized

_OUT = ("dataset_id", "row_id", "model_id", "score")
# Groups of models evaluated at a time: their many small jobs fill the cores together.
AT_ONCE = 4
_NEIGHBOUR_FAMILIES = ("KNN", "LOF", "ABOD", "COF")


def run_models(sample_df: DataFrame, models: DataFrame, seed: int = 0) -> DataFrame:
    """(dataset_id, row_id, model_id, score) of every requested model, higher = more anomalous.

    ``models`` are rows of the catalogue. Settings that share work are fitted together: one
    histogram per bin count, one set of cuts per bin count, one forest per feature share, one solver
    per kernel, and one neighbour join per metric serve all their models, and one scan scores all of
    a set of cuts, trees or neighbour counts. The samples are written once.
    """
    return _scores(durable(sample_df.select("dataset_id", "row_id", "features")), models, seed)


def _scores(rows: DataFrame, models: DataFrame, seed: int, asked: DataFrame | None = None) -> DataFrame:
    """Scores by every model, fitted on ``rows``; of the rows in ``asked`` only, if given."""
    own = rows if asked is None else asked
    wanted: dict[str, list[Row]] = {}
    for row in models.select("model_id", "family", "params").collect():  # at most 302 rows
        wanted.setdefault(row.family, []).append(row)
    parts: list[DataFrame] = []
    if "HBOS" in wanted:
        parts += _hbos(rows, wanted["HBOS"], own)
    if "LODA" in wanted:
        parts += _loda(rows, wanted["LODA"], seed, own)
    if "IForest" in wanted:
        parts += _iforest(rows, wanted["IForest"], seed, own)
    for kernel, group in _by(wanted.get("OCSVM", []), "kernel").items():
        of = {float(r.params["nu"]): r.model_id for r in group}
        model = ocsvm.ocsvm_fit_all(rows, sorted(of), kernel, seed=seed)
        parts.append(_named(ocsvm.ocsvm_scores_all(own, model, kernel), of, "nu"))
    parts += _neighbour_models(rows, wanted, asked)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(scores: DataFrame, of: dict[float, int], setting: str) -> DataFrame:
    """Rows tagged with the model of their setting."""
    ids = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return scores.withColumn("model_id", ids[F.col(setting)]).select(*_OUT)


def _by(rows: list[Row], key: str) -> dict[str, list[Row]]:
    groups: dict[str, list[Row]] = {}
    for row in rows:
        groups.setdefault(row.params[key], []).append(row)
    return groups


def _hbos(rows: DataFrame, wanted: list[Row], own: DataFrame) -> list[DataFrame]:
    ranges = sized(hbos.feature_ranges(rows))
    parts = []
    for n_bins, group in _by(wanted, "n_bins").items():
        model = hbos.hbos_fit(rows, int(n_bins), ranges)
        alphas = {float(r.params["alpha"]): r.model_id for r in group}
        ids = F.create_map(*[F.lit(x) for pair in alphas.items() for x in pair])
        scores = hbos.hbos_scores(own, model, list(alphas))
        parts.append(scores.withColumn("model_id", ids[F.col("alpha")]).select(*_OUT))
    return parts


def _loda(rows: DataFrame, wanted: list[Row], seed: int, own: DataFrame) -> list[DataFrame]:
    parts = []
    for n_bins, group in _by(wanted, "n_bins").items():
        most = max(int(r.params["n_random_cuts"]) for r in group)
        model = loda.loda_fit(rows, int(n_bins), most, seed)
        of = {int(r.params["n_random_cuts"]): r.model_id for r in group}
        parts.append(_named(loda.loda_scores(own, model, seed, sorted(of)), of, "cuts"))
    return parts


def _iforest(rows: DataFrame, wanted: list[Row], seed: int, own: DataFrame) -> list[DataFrame]:
    parts = []
    for share, group in _by(wanted, "max_features").items():
        most = max(int(r.params["n_estimators"]) for r in group)
        model = durable(iforest.iforest_fit(rows, most, float(share), seed))
        of = {int(r.params["n_estimators"]): r.model_id for r in group}
        parts.append(_named(iforest.iforest_scores(own, model, counts=sorted(of)), of, "trees"))
    return parts


def _neighbour_models(
    rows: DataFrame, wanted: dict[str, list[Row]], asked: DataFrame | None = None
) -> list[DataFrame]:
    own = asked
    if "LOF" in wanted or "COF" in wanted:
        # these compare a row with its neighbours' edges too
        asked = None
    needs: dict[str, int] = {}
    for family in _NEIGHBOUR_FAMILIES:
        for row in wanted.get(family, []):
            metric = _metric(row)
            needs[metric] = max(needs.get(metric, 0), int(row.params["n_neighbors"]))
    parts = []
    for metric, k in needs.items():
        edges = neighbors.knn_edges(rows, k, metric, asked=asked)
        parts += _edge_models(edges, rows, metric, wanted, own)
    return [part.select(*_OUT) for part in parts]


def _metric(row: Row) -> str:
    return "manhattan" if row.params.get("metric") == "manhattan" else "euclidean"


def _edge_models(
    edges: DataFrame, rows: DataFrame, metric: str, wanted: dict[str, list[Row]], own: DataFrame | None
) -> list[DataFrame]:
    """Scores by all models of one metric, by broadcast tables where these are small, else by joins."""
    lists = neighbor_tables.pack(edges, rows, own)
    kept: list[DataFrame] = []

    def every() -> DataFrame:
        if not kept:  # written only where joins need them
            kept.append(durable(edges))
        return kept[0]

    def mine() -> DataFrame:
        keys = ["dataset_id", "row_id"]
        return every() if own is None else every().join(own.select(*keys).distinct(), keys, "left_semi")

    parts = []
    group = [r for r in wanted.get("LOF", []) if _metric(r) == metric]
    if group:
        settings = {r.model_id: int(r.params["n_neighbors"]) for r in group}
        found = None if lists is None else neighbor_tables.lof_scores_all(lists, settings)
        parts += [neighbors.lof_scores_all(every(), settings)] if found is None else found
    if metric == "manhattan":
        return parts
    if "KNN" in wanted:
        settings = {r.model_id: (int(r.params["n_neighbors"]), r.params["method"]) for r in wanted["KNN"]}
        parts.append(
            neighbors.knn_scores_all(mine(), settings) if lists is None else neighbor_tables.knn_scores_all(lists, settings)
        )
    vectors = neighbor_tables.features(lists, rows) if lists is not None and {"ABOD", "COF"} & set(wanted) else None
    for family in ("ABOD", "COF"):
        if family not in wanted:
            continue
        settings, found = {r.model_id: int(r.params["n_neighbors"]) for r in wanted[family]}, None
        if vectors is not None:
            by_tables = {"ABOD": neighbor_tables.abod_scores_all, "COF": neighbor_tables.cof_scores_all}[family]
            found = by_tables(lists, vectors, settings)
        if found is None and family == "ABOD":
            found = neighbors.abod_scores_all(mine(), rows, settings)
        parts.append(neighbors.cof_scores_all(every(), rows, settings) if found is None else found)
    return parts


def performance_table(
    sample_df: DataFrame, models: DataFrame, seed: int = 0, digits: int | None = None
) -> DataFrame:
    """(dataset_id, model_id, ap): average precision of each model on labelled samples.

    Models are fitted on all rows; rows without a label are left out of the evaluation only, and so
    are not scored, nor have neighbours looked up where no other row's score needs theirs. ``digits``
    rounds the scores first, so that scores which differ by rounding errors tie.
    """
    # labels are often few; measured as small they are broadcast and the scores are not shuffled
    labels = sized(
        sample_df.where(F.col("label").isNotNull()).select("dataset_id", "row_id", "label")
    )
    rows = durable(sample_df.select("dataset_id", "row_id", "features"))
    asked = durable(rows.join(labels, ["dataset_id", "row_id"], "left_semi"))

    def evaluated(ids: list[int]) -> DataFrame:
        scores = _scores(rows, models.where(F.col("model_id").isin(ids)), seed, asked)
        if digits is not None:
            scores = scores.withColumn("score", F.round("score", digits))
        return average_precision(scores.join(labels, ["dataset_id", "row_id"])).select(
            "dataset_id", "model_id", "ap"
        )

    with ThreadPoolExecutor(AT_ONCE) as pool:
        run = inheritable_thread_target(rows.sparkSession)(evaluated)
        parts = list(pool.map(run, _evaluations(models)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _evaluations(models: DataFrame) -> list[list[int]]:
    """Model ids by what is evaluated in one plan: a family or kernel, or all that share a neighbour join."""
    groups: dict[tuple, list[int]] = {}
    for row in models.select("model_id", "family", "params").orderBy("model_id").collect():
        key = ("neighbours", _metric(row)) if row.family in _NEIGHBOUR_FAMILIES else (row.family, row.params.get("kernel"))
        groups.setdefault(key, []).append(row.model_id)
    # the neighbour joins take longest, then the solver's passes
    return [groups[key] for key in sorted(groups, key=lambda key: (key[0] != "neighbours", key != ("OCSVM", "rbf"), key[0] != "OCSVM", str(key)))]
