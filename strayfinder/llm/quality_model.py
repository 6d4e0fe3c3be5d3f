"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic steps.

Statistics of every whole text are taken once and written. Random cosines of the standardised
statistics approximate a Gaussian kernel; the normal equations are summed per partition and solved on
the driver, where their size depends on the number of features only. A fourth of the training rows is
kept out of the equations and calibrates the scores.

Bound: the model is fitted on at most about ``fit_rows`` labelled rows, chosen by a hash of the id.
Means and deviations of the statistics and all scores cover every row.

Defined results: null and empty texts have the statistics of no words and get a score like any other;
repeated rows get equal scores; an empty table gives an empty result; without labels, or with one
label only, every score is the share of label 1 (0.5 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strayfinder.llm import text as tx
from strayfinder.llm.calibration import Calibration, calibrate, training
from strayfinder.llm.quality_rules import measure
from strayfinder.session import durable

FEATURES = 256
FIT_ROWS = 200_000
FIT_TASKS = 8
RIDGE = 1e-3
WIDTH = 4.0
LOW, HIGH = -0.5, 1.5
STATISTICS = (
    "log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "log_lines", "capitals",
    "exclamations", "digits", "punctuation", "pipes", "distinct", "non_ascii", "sentence_ends", "line_words",
)


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_DIGIT, _POINT, _PIPE = _class(b"0123456789"), _class(b".,;:?'\"()-"), _class(b"|")
_END, _HIGH_BYTE = _class(b".?!"), _class(bytes(range(192, 256)))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, all finite."""
    m = {k: v.astype(float) for k, v in measure(column).items()}
    data, offsets = tx.flatten(column)
    starts, ends, bounds = tx.words(data, offsets)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    rows = tx.row_of(bounds).astype(np.uint64)
    _, first = np.unique(tx.mix(tx.span_hashes(data, starts, ends) + tx.mix(rows + np.uint64(1))), return_index=True)
    distinct = np.bincount(rows[first].astype(int), minlength=len(words))

    def share(lookup: np.ndarray, of: np.ndarray) -> np.ndarray:
        return tx.row_sums(lookup[data], offsets) / of

    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / words, np.log1p(m["n_lines"]),
        m["n_upper"] / chars, m["n_marks"] / words, share(_DIGIT, chars), share(_POINT, words),
        share(_PIPE, words), distinct / words, share(_HIGH_BYTE, chars), share(_END, words),
        np.log1p(words / np.maximum(m["n_lines"], 1)),
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text"):
            values = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(values[:, k]) for k in range(values.shape[1]))],
                names=["id", *STATISTICS],
            )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_measured, "id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Features:
    """Random cosines of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def of(cls, stats: DataFrame, count: int, width: float, seed: int) -> "Features":
        moments = stats.agg(*(f(s).alias(f"{f.__name__}_{s}") for s in STATISTICS for f in (F.avg, F.stddev_pop))).first()
        values = np.array([x or 0.0 for x in moments]).reshape(-1, 2)
        rng = np.random.default_rng(seed)
        return cls(
            values[:, 0],
            np.where(values[:, 1] > 1e-9, values[:, 1], 1.0),
            rng.normal(0.0, 1.0 / width, (len(STATISTICS), count)),
            rng.uniform(0.0, 2 * np.pi, count),
        )

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6.0, 6.0)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.column_stack([np.ones(len(z)), cosines])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])


def solve(rows: DataFrame, features: Features, ridge: float) -> np.ndarray:
    """Ridge weights; each of ``FIT_TASKS`` tasks sends one pair of sums of a fixed size."""
    size = len(features.phases) + 1

    def sums(batches):
        gram, target, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z = features(_matrix(batch))
            gram += z.T @ z
            target += z.T @ batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            n += len(z)
        yield pa.RecordBatch.from_arrays(
            [pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), pa.array([n], pa.int64())],
            names=["gram", "target", "n"],
        )

    parts = rows.repartition(FIT_TASKS).mapInArrow(sums, "gram binary, target binary, n long").collect()
    gram = sum((np.frombuffer(p["gram"]).reshape(size, size) for p in parts), np.zeros((size, size)))
    target = sum((np.frombuffer(p["target"]) for p in parts), np.zeros(size))
    n = max(sum(p["n"] for p in parts), 1)
    penalty = np.full(size, ridge * n)
    penalty[0] = 1e-6 * n
    return np.linalg.solve(gram + np.diag(penalty), target)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    calibration: Calibration | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: DataFrame) -> DataFrame:
        """(id, raw, score) of measured rows."""

        def scored(batches):
            for batch in batches:
                raw = self.raw(_matrix(batch)) if batch.num_rows else np.empty(0)
                score = self.calibration(raw) if self.calibration else raw
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(raw), pa.array(score)], names=["id", "raw", "score"]
                )

        return stats.mapInArrow(scored, "id long, raw double, score double")


def fit(
    stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
    fit_rows: int = FIT_ROWS, count: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = 5,
) -> Model:
    # of a repeated id the text with the smallest statistics teaches, in every run the same
    one = stats.groupBy("id").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("id", "s.*")
    taught = durable(training(labels, id_col, label_col, fit_rows).join(one, "id"))
    features = Features.of(stats, count, width, seed)
    model = Model(features, solve(taught.where(~F.col("calibrates")), features, ridge))
    kept = taught.where("calibrates")
    scored = model.score(kept).join(kept.select("id", "label"), "id")
    model.calibration = calibrate(scored, "raw", "label", LOW, HIGH)
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **options) -> DataFrame:
    """(id, raw, score) of every document."""
    stats = durable(measured(docs))
    return fit(stats, labels, label_col, **options).score(stats)
