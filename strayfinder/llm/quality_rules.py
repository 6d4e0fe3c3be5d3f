"""Rule bitmask ledger: every rule is evaluated once per text; policies and ablations read the bits.

``ledger`` measures each text once and stores the measurements with one failure bit per rule.
A policy is a versioned set of rules, so it is one bitwise AND over the stored ledger, and an
ablation (what would pass without one rule) is a count over the few distinct bit patterns.

Defined results: a null or empty text has no words, so every count is 0 and the rules ``few_words``
and ``word_length`` fail; texts of any length are read whole; equal rows get equal results, one per input row; an empty
table gives an empty ledger; columns other than id and text are ignored by ``ledger`` and carried
unchanged by ``passing``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strayfinder.llm import text as tx

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_marks",
)
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the position in RULES is the bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("exclamations", "5 * n_marks > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words or n_words = 0"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A text passes when none of the named rules fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "symbols", "repeated_lines"))
V2 = Policy("v2", tuple(rule.name for rule in RULES))
POLICIES = (BASE, V1, V2)


def _lookup(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL, _UPPER, _MARK = _lookup(SYMBOLS), _lookup(bytes(range(65, 91))), _lookup(b"!")


def _repeated_words(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, the words inside windows that occur twice or more in that row."""
    flags = np.zeros(len(tokens) + WINDOW, dtype=bool)
    starts = tx.inner(bounds, WINDOW)
    if len(starts):
        rows = tx.row_of(bounds)[starts].astype(np.uint64)
        keys = tx.mix(tx.window_hashes(tokens, WINDOW)[starts] + tx.mix(rows + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(starts), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for step in range(WINDOW):
            flags[starts[twice] + step] = True
    return tx.row_sums(flags[: len(tokens)], bounds)


def _repeated_lines(
    data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the lines with a word and those among them equal to an earlier one."""
    starts, ends = tx.runs(data != 10, offsets)
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[full], ends[full]
    bounds = tx.per_row(starts, offsets)
    rows = tx.row_of(bounds)
    keys = tx.mix(tx.span_hashes(data, starts, ends) + tx.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    lines = np.diff(bounds)
    return lines, lines - np.bincount(rows[first], minlength=len(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a slice of texts."""
    data, offsets = tx.flatten(column)
    starts, ends, bounds = tx.words(data, offsets)
    tokens = tx.span_hashes(data, starts, ends)
    lines, repeated = _repeated_lines(data, offsets, starts)
    return {
        "n_words": np.diff(bounds),
        "word_chars": tx.row_sums(tx.WORD[data] & tx.LEADING[data], offsets),
        "n_symbols": tx.row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": repeated,
        "n_repeat_words": _repeated_words(tokens, bounds),
        "n_lines": lines,
        "n_upper": tx.row_sums(_UPPER[data], offsets),
        "n_marks": tx.row_sums(_MARK[data], offsets),
    }


def failure_bits() -> Column:
    """The bitmask of all rules over the measurement columns."""
    return sum(
        (F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES),
        F.lit(0),
    ).cast("long")


def fails(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask)) != 0


def _measured(batches: Iterator[pa.RecordBatch], text: int, carried: int) -> Iterator[pa.RecordBatch]:
    """The first ``carried`` columns with the measurements of column ``text`` behind them."""
    for batch in batches:
        named = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{k}" for k in range(batch.num_columns)])
        for part in tx.slices(named, f"c{text}"):
            counts = measure(part.column(text))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:carried], *(pa.array(counts[m], pa.int64()) for m in MEASURES)],
                names=[*(f"c{k}" for k in range(carried)), *MEASURES],
            )


def _with_measures(frame: DataFrame, text: int, carried: int) -> DataFrame:
    """Columns become c0, c1, ... on the way, so that no name can clash."""
    fields = [T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(frame.schema.fields)]
    schema = T.StructType([*fields[:carried], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return frame.toDF(*(f.name for f in fields)).mapInArrow(
        lambda batches: _measured(batches, text, carried), schema
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, all measurements and ``bits``, a failure bit per rule."""
    measured = _with_measures(docs.select(docs[id_col], docs[text_col]), 1, 1)
    return measured.withColumnRenamed("c0", id_col).withColumn("bits", failure_bits())


def decide(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A stored ledger with one boolean column ``pass_<version>`` per policy."""
    return rows.withColumns({f"pass_{p.version}": ~fails(F.col("bits"), p) for p in policies})


def ablation(rows: DataFrame, policy: Policy = V2) -> DataFrame:
    """Per rule of ``policy``: rows failing it, and rows that fail nothing else of the policy."""
    patterns = rows.groupBy(F.col("bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rules = [(name, BIT[name]) for name in policy.rules]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules)))
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def passing(docs: DataFrame, policy: Policy = V2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their columns as they were."""
    names = docs.columns
    measured = _with_measures(docs, names.index(text_col), len(names))
    kept = measured.where(~fails(failure_bits(), policy))
    return kept.select(*(F.col(f"c{k}") for k in range(len(names)))).toDF(*names)
