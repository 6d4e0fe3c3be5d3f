"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Ordinary windows train the first dictionary. Toxic text is mostly ordinary too, so the second one holds
the same content and, before it, a dictionary trained on the runs of words that toxic texts use, or
whose beginning they use, in many more contexts than ordinary ones do: toxic text with all other words
weighted zero. Contexts are distinct (word, next word) pairs; copies of one text therefore count once.

Every text is cut into windows; a window is the more toxic the shorter the second dictionary makes it.
Bytes saved beyond ``clear`` count twice. Two numbers judge a text: the mean gain of its windows, with
``prior`` windows without a gain added, so that a short text needs more than a chance match; and its
strongest run of neighbouring windows, each less ``drift``, over the logarithm of their number, so that
one toxic passage in a long text is found. Calibrated thresholds (isotonic) turn each into a
probability, and the larger one into the score. ``clear``, ``prior`` and ``drift`` are those of
``WHOLE`` and ``RUNS`` that order best the training rows that no dictionary learned from.

Bounds, all parameters: dictionaries and thresholds are learned from at most about ``fit_rows``
labelled rows chosen by a hash of the id, whole texts; ``max_words`` marked words; windows of
``sample_window`` characters, in hash order up to ``sample_bytes``, train a dictionary. All windows of
every text are scored. Letters A-Z are lower-cased, in training as in scoring.

Defined results: null and empty texts have no window and gains of 0; repeated rows get equal scores;
an empty table gives an empty result; without toxic examples both dictionaries are the same and every
gain is 0; other columns are not read; ids are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, functions as F

from strayfinder.llm import text as tx
from strayfinder.llm.calibration import Calibration, thresholds, training

FIT_ROWS = 12_000
WINDOW = 64
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
#: fixed values: the initial repeat offsets 1, 4, 8 that end a dictionary's header
REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
STEMS = (4, 5)
MAX_WORDS = 2_000
SAMPLE_BYTES = 4 << 20
SAMPLE_WINDOW = 256
RUN = 8
CONTEXTS, TEXTS, LIFT = 5, 3, 8.0
#: (clear, prior) of the mean gain and (clear, drift) of the strongest run, to choose from
WHOLE = ((2, 2), (2, 5), (2, 10), (4, 2), (4, 5), (4, 10))
RUNS = ((2, 0.5), (2, 1.0), (2, 1.5), (4, 0.5), (4, 1.0), (4, 1.5))
WHOLE_RANGE, RUN_RANGE = (-4.0, 16.0), (0.0, 64.0)
BREAK = r"[ \t\n\x0B\f\r]+"


def windows(data: bytes, width: int = WINDOW) -> list[bytes]:
    """Consecutive windows of at most ``width`` bytes, cut behind a space where there is one."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + width)
        if end < len(data):
            space = data.rfind(b" ", at + width // 2, end)
            end = space + 1 if space > 0 else end
        out.append(b" " + data[at:end])
        at = end
    return out


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def _words(text: Column) -> Column:
    return F.filter(F.split(_lower(text), BREAK), lambda w: w != "")


def _terms(word: Column) -> Column:
    """A word and its beginnings, which inflected forms share."""
    return F.array_distinct(F.array(word, *(F.concat(F.substring(word, 1, k), F.lit("*")) for k in STEMS)))


def marked_terms(taught: DataFrame, most: int = MAX_WORDS) -> list[str]:
    """Words and beginnings (``abcd*``) with many contexts in toxic texts and, by share, few in others."""
    words = taught.select("id", "label", _words(F.col("text")).alias("w"))
    following = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("n")
    pairs = words.select("id", "label", F.explode(F.arrays_zip("w", following)).alias("p"))
    # all copies of a context belong to the first text that has it
    contexts = pairs.groupBy("label", F.col("p.w").alias("w"), F.xxhash64("p.n").alias("next")).agg(
        F.min("id").alias("id")
    )
    counts = contexts.select("label", "id", F.explode(_terms(F.col("w"))).alias("term")).groupBy("term").agg(
        F.count_if(F.col("label") == 1).alias("toxic"),
        F.count_if(F.col("label") == 0).alias("ordinary"),
        F.approx_count_distinct(F.when(F.col("label") == 1, F.col("id"))).alias("texts"),
    )
    toxic, ordinary = (float(x or 0) for x in contexts.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    ).first())
    share = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("ordinary") + 0.5) / (ordinary + 1))
    chosen = counts.where((F.col("toxic") >= CONTEXTS) & (F.col("texts") >= TEXTS) & (share >= LIFT))
    return [r["term"] for r in chosen.orderBy(F.desc("toxic"), "term").limit(most).collect()]


def _train(size: int, samples: list[bytes]) -> bytes:
    """Dictionary content of at most ``size`` bytes; too few samples are taken as they are."""
    try:
        whole = zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]
    head, mark, content = whole.partition(REPEATS)  # entropy tables end with the repeat offsets
    return content if mark else whole


def _samples(rows: DataFrame, column: str, limit: int) -> list[bytes]:
    """Samples in hash order until ``limit`` bytes; the rows come from the bounded training set."""
    out, size = [], 0
    for row in rows.select(column, F.xxhash64(column).alias("h")).orderBy("h", column).toLocalIterator():
        data = row[0].encode()
        if size + len(data) > limit:
            break
        out.append(data)
        size += len(data)
    return out


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        settings = zs.ZstdCompressionParameters.from_level(
            3, source_size=WINDOW, dict_size=ORDINARY_BYTES + TOXIC_BYTES, min_match=4,
            strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False,
        )

        def build(content: bytes) -> zs.ZstdCompressor:
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT) if content else None
            return zs.ZstdCompressor(dict_data=held, compression_params=settings)

        return build(self.ordinary), build(self.toxic)


def train(
    taught: DataFrame, sample_bytes: int = SAMPLE_BYTES, max_words: int = MAX_WORDS, sample_window: int = SAMPLE_WINDOW
) -> Dictionaries:
    """Both dictionaries from (id, label, text) rows."""
    marked = marked_terms(taught, max_words)
    pieces = F.regexp_extract_all(_lower(F.col("text")), F.lit(f"(?s).{{1,{sample_window}}}"), F.lit(0))
    ordinary = taught.where("label = 0").select(F.explode(pieces).alias("s"))
    base = _train(ORDINARY_BYTES, _samples(ordinary, "s", sample_bytes))
    if not marked:
        return Dictionaries(base, base)
    terms = F.array(*(F.lit(t) for t in marked))
    hits = F.filter(_words(F.col("text")), lambda w: F.arrays_overlap(_terms(w), terms))
    runs = (
        taught.where(F.col("label") == 1)
        .select(hits.alias("w"))
        .where(F.size("w") > 0)
        .select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / RUN).cast("int")),
                                      lambda k: F.concat(F.lit(" "), F.array_join(F.slice("w", k * RUN + 1, RUN), " "), F.lit(" ")))).alias("s"))
    )
    return Dictionaries(base, _train(TOXIC_BYTES, _samples(runs, "s", sample_bytes)) + base)


def whole_gain(saved: np.ndarray, clear: float, prior: float) -> float:
    """Mean of the windows' gains, bytes beyond ``clear`` twice, with ``prior`` windows without a gain."""
    return float((saved + np.maximum(saved - clear, 0)).sum() / (len(saved) + prior))


def run_gain(saved: np.ndarray, clear: float, drift: float) -> float:
    """Largest sum of neighbouring windows' gains, each less ``drift``, over the log of the windows."""
    total = np.concatenate(([0.0], np.cumsum(saved + np.maximum(saved - clear, 0) - drift)))
    return float((total - np.minimum.accumulate(total)).max() / np.log(len(saved) + 5))


def gains(
    docs: DataFrame, dictionaries: Dictionaries, whole: tuple = WHOLE, runs: tuple = RUNS
) -> DataFrame:
    """(id, windows, whole, run) of (id, text): the mean gain and the strongest run under each setting."""

    def measure(batches):
        ordinary, toxic = dictionaries.compressors()
        for batch in batches:
            for part in tx.slices(batch, "text"):
                means, best, count = [], [], []
                for text in part.column("text").to_pylist():
                    pieces = windows((text or "").encode().lower())
                    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in pieces], dtype=float)
                    means.append([whole_gain(saved, *s) for s in whole])
                    best.append([run_gain(saved, *s) for s in runs])
                    count.append(len(pieces))
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(count, pa.int64()), pa.array(means, kind), pa.array(best, kind)],
                    names=["id", "windows", "whole", "run"],
                )

    return docs.select("id", "text").mapInArrow(measure, "id long, windows long, whole array<double>, run array<double>")


def ordering(values: np.ndarray, labels: np.ndarray) -> float:
    """Share of (toxic, ordinary) pairs that ``values`` order rightly, ties half."""
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    toxic = int(labels.sum())
    pairs = toxic * (len(labels) - toxic)
    return float((rank[labels == 1].sum() - toxic * (toxic + 1) / 2) / pairs) if pairs else 0.5


@dataclass
class Judge:
    """The settings chosen and the thresholds of both numbers and of the larger probability."""

    whole: tuple[float, float]
    run: tuple[float, float]
    thresholds: tuple[Calibration, Calibration, Calibration]

    def __call__(self, whole: np.ndarray, run: np.ndarray) -> np.ndarray:
        of_whole, of_run, of_both = self.thresholds
        return of_both(np.maximum(of_whole(whole), of_run(run)))


def judge(measured: DataFrame) -> Judge:
    """Settings and thresholds from (label, whole, run) rows, those of the bounded calibration set."""
    rows = measured.select("label", "whole", "run").toPandas()
    labels = rows["label"].to_numpy(dtype=int)
    chosen = []
    for column, settings in (("whole", WHOLE), ("run", RUNS)):
        table = np.array(rows[column].tolist(), dtype=float).reshape(len(rows), len(settings))
        best = max(range(len(settings)), key=lambda k: (ordering(table[:, k], labels), -k))
        chosen.append((settings[best], table[:, best]))
    (whole, a), (run, b) = chosen
    of_whole, of_run = thresholds(a, labels, *WHOLE_RANGE), thresholds(b, labels, *RUN_RANGE)
    both = thresholds(np.maximum(of_whole(a), of_run(b)), labels, 0.0, 1.0)
    return Judge(whole, run, (of_whole, of_run, both))


def classify(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, gain, run, windows, score) of every document."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # at most about fit_rows ids, so the small side is bounded by a parameter
    chosen = F.broadcast(training(labels, id_col, label_col, fit_rows))
    taught = rows.join(chosen, "id").persist()
    dictionaries = train(taught.where(~F.col("calibrates")))
    kept = taught.where("calibrates")
    verdict = judge(gains(kept, dictionaries).join(kept.select("id", "label").distinct(), "id"))
    taught.unpersist()

    def score(batches):
        for batch in batches:
            whole, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gain", "run"))
            yield batch.append_column("score", pa.array(verdict(whole, run)))

    measured = gains(rows, dictionaries, (verdict.whole,), (verdict.run,)).select(
        "id", F.col("whole")[0].alias("gain"), F.col("run")[0].alias("run"), "windows"
    )
    return measured.mapInArrow(score, "id long, gain double, run double, windows long, score double")
