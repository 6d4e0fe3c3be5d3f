"""Language of texts, word by word: a linear-chain conditional random field.

Words are runs of letters (with their marks), lower-cased. A word's state is a language; its score sums
the weights of its beginnings and endings, its n-grams with word borders, and its entry in a lexicon that
is counted over all training texts. Learned transitions say how readily neighbouring words change the
language. Forward and backward sums give every word's probabilities; a text has the language with the
largest mean, which is its score. ``label_words`` returns the runs of one language inside each text.

Training texts are in one language each, so chains that switch are made of them: all texts of a training
block are cut into runs of words, the runs are shuffled and laid end to end. ``fit_tasks`` blocks follow
the gradient of the likelihood on their own and their weights are averaged after every round.

Bounds, all parameters: weights are fitted on at most about ``fit_rows`` rows, as many of each language,
chosen by a hash of text and id, whole texts; the lexicon holds about the ``lexicon_words`` words with the highest
share in a language's words. Lexicon counts cover all training rows; every word of every text is labelled.
A model has 2**16 weights per language, so languages should be hundreds at most.

Long chains are cut into chunks that are walked side by side; the product of a chunk's matrices carries
the sums across its borders, so the result is that of the whole chain.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows all
texts are; repeated rows get equal results; rows with a null id are not learned from; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strayfinder.llm import text as tx
from strayfinder.llm.calibration import held_out
from strayfinder.session import durable

HASHED_BITS = 16
HASHED = 1 << HASHED_BITS
AFFIXES = (1, 2, 3, 4)
NGRAMS = (1, 2, 3, 4)
SHARES = (0.5, 0.9, 0.99)
FIT_ROWS, FIT_TASKS, ROUNDS, EPOCHS = 4_000, 8, 3, 2
LEXICON_WORDS = 40_000
RUN, STEPS, CHAINS = 16, 64, 64
RATE, DECAY = 0.3, 1e-6
CHUNK, RESCALE = 1024, 8
SLICE_BYTES = 4 << 20
LEVELS = 64
COUNTED_WORDS = 1_000_000
UNKNOWN = "und"


# --- words ----------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def borders() -> tuple[np.ndarray, np.ndarray]:
    """Code points at which letters, and letters with marks, begin or end; small enough to ship."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    letter = kinds == ord("L")
    inside = letter | (kinds == ord("M"))
    return tuple(np.flatnonzero(np.diff(x.astype(np.int8), prepend=0, append=0)) for x in (letter, inside))


def _member(edges: np.ndarray) -> np.ndarray:
    out = np.zeros(0x110001, np.int8)
    out[edges] = 1
    return np.cumsum(out, dtype=np.int64)[:0x110000] % 2 == 1


class Alphabet:
    """Lookup tables of a task."""

    def __init__(self, edges: tuple[np.ndarray, np.ndarray]) -> None:
        self.letter, self.inside = (_member(e) for e in edges)


def _lower(text: str) -> str:
    """Lower case with the same number of characters, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """Words of a slice of texts: code points, spans in them, rows, and ids of the distinct words."""

    codes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    ids: np.ndarray


def words(column: pa.Array, alphabet: Alphabet) -> Words:
    texts = [_lower((raw or b"").decode("utf-8", "replace")) for raw in column.cast(pa.large_binary()).to_pylist()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    starts, ends = tx.runs(alphabet.inside[codes], offsets)
    marked = np.flatnonzero(~alphabet.letter[codes[starts]])  # runs that begin with a mark need a letter behind
    if len(marked):
        empty = [k for k in marked if not alphabet.letter[codes[starts[k] : ends[k]]].any()]
        starts, ends = np.delete(starts, empty), np.delete(ends, empty)
    hashes, first, ids = np.unique(tx.span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    return Words(codes, offsets, starts, ends, tx.per_row(starts, offsets), hashes, first, ids)


def _slots(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 of every count, end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Lexicon:
    """Sorted word hashes and their features: the language that a word prefers, and how clearly."""

    hashes: np.ndarray
    entry: np.ndarray
    kinds: int

    def features(self, hashes: np.ndarray) -> np.ndarray:
        """Feature of each word beyond the hashed ones; the last stands for unlisted words."""
        if not len(self.hashes):
            return np.full(len(hashes), HASHED + self.kinds)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return HASHED + np.where(self.hashes[at] == hashes, self.entry[at], self.kinds)


def _window_sums(tokens: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours times odd factors; their high bits are a universal hash."""
    count = max(len(tokens) - width + 1, 0)
    out = np.zeros(count, np.uint64)
    for j, factor in enumerate(tx.powers(0xD6E8FEB86659FD93 + 2 * width, width + 2)[2:]):
        out += tokens[j : j + count] * factor
    return out


def _hashed(sums: np.ndarray, kind: int) -> np.ndarray:
    factor = tx.powers(0x9E3779B97F4A7C15, kind + 2)[kind + 1]
    return ((sums * factor) >> np.uint64(64 - HASHED_BITS)).astype(np.int64)


def features(w: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words, the bounds of each word in them, and each word's weight per feature."""
    starts, ends = w.starts[w.first], w.ends[w.first]
    sizes = ends - starts
    n = len(sizes)
    if n == 0:
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0)
    padded = np.zeros(int(sizes.sum()) + 2 * n, np.uint64)  # a border on both sides of each word
    bounds = np.concatenate(([0], np.cumsum(sizes + 2)))
    slots = _slots(sizes)
    padded[np.repeat(bounds[:-1] + 1, sizes) + slots] = w.codes[np.repeat(starts, sizes) + slots].astype(np.uint64) + np.uint64(1)
    owner = tx.row_of(bounds)
    # how many features of each kind a word has, and so where each kind begins among the word's
    counts = [np.ones(n, np.int64)]
    counts += [np.maximum(sizes + 3 - width, 0) for width in NGRAMS]
    counts += [(sizes > width).astype(np.int64) for width in AFFIXES for _ in ("beginning", "ending")]
    total = sum(counts)
    out_bounds = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(int(out_bounds[-1]), np.int64)
    begin = out_bounds[:-1].copy()
    out[begin] = lexicon.features(w.hashes)
    begin += counts[0]
    sums = {width: _window_sums(padded, width) for width in {*NGRAMS, *AFFIXES}}
    for width, count in zip(NGRAMS, counts[1:]):
        at = tx.inner(bounds, width)
        out[(begin - bounds[:-1])[owner[at]] + at] = _hashed(sums[width][at], 0)
        begin += count
    for width in AFFIXES:
        long = np.flatnonzero(sizes > width)
        for salt, at in ((1, bounds[:-1][long] + 1), (2, bounds[1:][long] - 1 - width)):
            out[begin[long]] = _hashed(sums[width][at], salt)
            begin[long] += 1
    return out, out_bounds, 1.0 / np.sqrt(total)


# --- the chain ------------------------------------------------------------------------------------


def emissions(weights: np.ndarray, found: np.ndarray, bounds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Score of every distinct word in every language."""
    if len(bounds) == 1:
        return np.empty((0, weights.shape[1]))
    return np.add.reduceat(weights[found], bounds[:-1], axis=0) * share[:, None]


def _scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def marginals(scores: np.ndarray, switch: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Probability of every state at every place of the chains that ``bounds`` cut out of ``scores``.

    Forward and backward sums run along all chunks of all chains at once; the product of a chunk's
    matrices tells the sums at its border, which a short walk along the chunks of a chain hands on.
    """
    states = scores.shape[1]
    out = np.empty_like(scores)
    lengths = np.diff(bounds)
    pieces = -(-lengths // chunk)
    if not len(scores):
        return out
    chain = np.repeat(np.arange(len(lengths)), pieces)
    place = _slots(pieces)
    begin = bounds[:-1][chain] + place * chunk
    size = np.minimum(bounds[1:][chain] - begin, chunk)
    by_size = np.argsort(-size, kind="stable")  # full chunks first, so a step works on a leading part
    rank = np.empty_like(by_size)
    rank[by_size] = np.arange(len(by_size))
    begin, size = begin[by_size], size[by_size]
    steps, n = int(size[0]), len(size)
    active = np.searchsorted(-size, -np.arange(steps), "left")  # chunks longer than each step
    local = _scaled(scores)
    move = np.exp(switch - switch.max())

    # product of a chunk's steps, without a move before its first place, where a chain has several
    longest = int(pieces.max())
    several = np.flatnonzero(pieces[chain[by_size]] > 1)
    slot = np.cumsum(pieces[chain[by_size]] > 1) - 1
    product = np.empty((len(several), states, states))
    product[:] = np.eye(states)
    for t in range(steps if longest > 1 else 0):
        m = int(np.searchsorted(several, active[t]))
        step = product[:m] if t == 0 else (product[:m].reshape(-1, states) @ move).reshape(m, states, states)
        product[:m] = step * local[begin[several[:m]] + t][:, None, :]
        if t % RESCALE == RESCALE - 1:
            product[:m] /= product[:m].max(axis=(1, 2), keepdims=True)
    entry = np.ones((n, states))
    leave = np.ones((n, states))
    first = np.cumsum(pieces) - pieces
    for k in range(1, longest):
        here, before = rank[first[pieces > k] + k], rank[first[pieces > k] + k - 1]
        value = np.einsum("ns,nst->nt", entry[before], product[slot[before]]) @ move
        entry[here] = value / value.sum(axis=1, keepdims=True)
        here, behind = rank[(first + pieces - 1 - k)[pieces > k]], rank[(first + pieces - k)[pieces > k]]
        value = np.einsum("nst,nt->ns", product[slot[behind]], leave[behind]) @ move.T
        leave[here] = value / value.sum(axis=1, keepdims=True)

    value = entry
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        value = (value[:m] if t == 0 else value[:m] @ move) * local[at]
        value /= value.sum(axis=1, keepdims=True)
        out[at] = value
    value = leave
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        both = out[at] * value[:m]
        out[at] = both / both.sum(axis=1, keepdims=True)
        step = (value[:m] * local[at]) @ move.T
        value[:m] = step / step.sum(axis=1, keepdims=True)
    return out


def likelihood(scores: np.ndarray, switch: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of (chains, steps) true states and its gradient by scores and transitions."""
    chains, steps, states = scores.shape
    local = _scaled(scores)
    peak = scores.max(axis=-1)
    move, top = np.exp(switch - switch.max()), switch.max()
    forward, scale = np.empty_like(scores), np.empty((chains, steps))
    for t in range(steps):
        value = local[:, t] if t == 0 else (forward[:, t - 1] @ move) * local[:, t]
        scale[:, t] = value.sum(axis=1)
        forward[:, t] = value / scale[:, t, None]
    backward = np.ones_like(scores)
    for t in range(steps - 2, -1, -1):
        value = (backward[:, t + 1] * local[:, t + 1]) @ move.T
        backward[:, t] = value / value.sum(axis=1, keepdims=True)
    state = forward * backward
    state /= state.sum(axis=2, keepdims=True)
    pairs = forward[:, :-1, :, None] * move * (local * backward)[:, 1:, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    total = np.log(scale).sum() + peak.sum() + chains * (steps - 1) * top
    seen = np.zeros((states, states))
    np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
    picked = np.take_along_axis(scores, truth[:, :, None], 2).sum() + (seen * switch).sum()
    by_scores = -state
    np.put_along_axis(by_scores, truth[:, :, None], np.take_along_axis(by_scores, truth[:, :, None], 2) + 1, 2)
    return float(picked - total), by_scores, seen - pairs.sum(axis=(0, 1))


def train_block(
    column: pa.Array, labels: np.ndarray, alphabet: Alphabet, lexicon: Lexicon, weights: np.ndarray,
    switch: np.ndarray, seed: int, epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient steps over the switching chains that a block's texts make."""
    w = words(column, alphabet)
    weights, switch = weights.astype(float), switch.copy()
    if not len(w.ids):
        return weights, switch
    found, bounds, share = features(w, lexicon)
    truth = np.repeat(labels, np.diff(w.bounds))
    rng = np.random.default_rng(seed)
    squares, moved = np.full(weights.shape, 1e-8), np.full(switch.shape, 1e-8)
    for _ in range(epochs):
        begins = rng.random(len(truth)) < 1.0 / RUN
        begins[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(truth))
        runs = rng.permutation(len(cuts) - 1)
        lengths = np.diff(cuts)[runs]
        order = np.repeat(cuts[runs], lengths) + _slots(lengths)
        rows = -(-len(order) // STEPS)
        order = np.resize(order, rows * STEPS).reshape(rows, STEPS)  # the last chain ends with first words
        for low in range(0, rows, CHAINS):
            part = order[low : low + CHAINS]
            own, place = np.unique(w.ids[part], return_inverse=True)
            counts = np.diff(bounds)[own]
            used = found[np.repeat(bounds[own], counts) + _slots(counts)]
            own_bounds = np.concatenate(([0], np.cumsum(counts)))
            scores = emissions(weights, used, own_bounds, share[own])[place.reshape(part.shape)]
            _, by_scores, by_switch = likelihood(scores, switch, truth[part])
            each = part.size
            at = place.ravel()
            for s in range(weights.shape[1]):
                by_word = np.bincount(at, by_scores[:, :, s].ravel(), len(own)) * share[own]
                slope = np.bincount(used, np.repeat(by_word, counts), len(weights)) / each - DECAY * weights[:, s]
                squares[:, s] += slope**2
                weights[:, s] += RATE * slope / np.sqrt(squares[:, s])
            slope = by_switch / each
            moved += slope**2
            switch += RATE * slope / np.sqrt(moved)
    return weights, switch


# --- fitting and labelling ------------------------------------------------------------------------


@dataclass
class Tagger:
    """Languages, lexicon, weights and transitions; ``edges`` make the letter tables."""

    languages: list[str]
    edges: tuple[np.ndarray, np.ndarray]
    lexicon: Lexicon
    weights: np.ndarray
    switch: np.ndarray

    def tag(self, column: pa.Array, alphabet: Alphabet) -> tuple[Words, np.ndarray]:
        """Words of the texts and the probability of each language for each."""
        w = words(column, alphabet)
        scores = emissions(self.weights, *features(w, self.lexicon))
        return w, marginals(scores[w.ids], self.switch, w.bounds)


def _counted(edges, languages: list[str]):
    """Word counts by language, gathered over a task up to ``COUNTED_WORDS`` distinct words."""

    def emit(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, langs, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((langs, hashes))
        hashes, langs, counts = hashes[order], langs[order], counts[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (langs[1:] != langs[:-1])))
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes[at].view(np.int64)), pa.array(langs[at], pa.int32()), pa.array(np.add.reduceat(counts, at), pa.int64())],
            names=["word", "lang", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet(edges)
        place = {l: k for k, l in enumerate(languages)}
        held, size = [], 0
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                w = words(part.column("text"), alphabet)
                if not len(w.ids):
                    continue
                langs = np.array([place[l] for l in part.column("lang").to_pylist()])
                keys = w.ids.astype(np.int64) * len(languages) + np.repeat(langs, np.diff(w.bounds))
                keys, counts = np.unique(keys, return_counts=True)
                held.append((w.hashes[keys // len(languages)], keys % len(languages), counts))
                size += len(keys)
                if size >= COUNTED_WORDS:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def lexicon(taught: DataFrame, languages: list[str], edges, most: int) -> Lexicon:
    """The words with the largest share of a language's words, counted over all of ``taught``."""
    counts = taught.select("text", "lang").mapInArrow(_counted(edges, languages), "word long, lang int, n long")
    kinds = len(languages) * (len(SHARES) + 1)
    by_word = counts.groupBy("word").agg(
        *(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(languages)))
    )
    by_word = durable(by_word)
    names = [f"n{k}" for k in range(len(languages))]
    totals = [float(x or 0) for x in by_word.agg(*(F.sum(n) for n in names)).first()]
    rates = [F.col(n) / max(t, 1.0) for n, t in zip(names, totals)]
    top = F.greatest(*rates) if len(rates) > 1 else rates[0]
    # bins of the highest share tell where the list ends, so tasks send the driver listed words only
    level = F.floor(F.log2(top) * LEVELS).cast("int")
    rows = by_word.select("word", *(r.alias(f"r{k}") for k, r in enumerate(rates)), level.alias("level"))
    sizes = sorted(((r["level"], r["count"]) for r in rows.groupBy("level").count().collect()), reverse=True)
    room, last, part = most, None, 0.0
    for bin_, n in sizes:
        last, part = bin_, min(1.0, room / n)
        room -= n
        if room <= 0:
            break
    # of the last bin, words by a hash
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))
    kept = rows.where((F.col("level") > last) | ((F.col("level") == last) & drawn) if sizes else F.lit(False)).toPandas()
    values = kept[[f"r{k}" for k in range(len(languages))]].to_numpy(float)
    best = values.argmax(axis=1) if len(kept) else np.empty(0, int)
    share = values.max(axis=1) / np.maximum(values.sum(axis=1), 1e-300) if len(kept) else np.empty(0)
    entry = best * (len(SHARES) + 1) + np.searchsorted(SHARES, share, "right")
    hashes = kept["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], entry[order], kinds)


def fit(
    rows: DataFrame, fit_rows: int = FIT_ROWS, lexicon_words: int = LEXICON_WORDS, fit_tasks: int = FIT_TASKS,
    rounds: int = ROUNDS, epochs: int = EPOCHS,
) -> Tagger | None:
    """A tagger from (id, text, lang) rows that are not held out; None where nothing is labelled."""
    usable = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    found = sorted((r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect())
    languages = [l for l, _ in found]
    if not languages:
        return None
    edges = borders()
    listed = lexicon(usable, languages, edges, lexicon_words)
    each = max(fit_rows // len(languages), 1)
    draw = F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(1 << 30))
    share = F.lit(0)
    for l, n in found:
        share = F.when(F.col("lang") == l, int(min(1.0, each / n) * (1 << 30))).otherwise(share)
    # equal texts are learned once, so a row that repeats does not lift the bound
    chosen = usable.where(draw < share).select("text", "lang").dropDuplicates(["text", "lang"])
    block = F.pmod(F.xxhash64("text", "lang"), F.lit(fit_tasks)).cast("int")
    sample = durable(chosen.withColumn("block", block).repartition(fit_tasks, "block"))
    place = {l: k for k, l in enumerate(languages)}
    weights = np.zeros((HASHED + listed.kinds + 1, len(languages)), np.float32)
    switch = np.zeros((len(languages), len(languages)))
    for k in range(rounds):
        start, moves = weights, switch

        def block_step(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["lang", "text"])
            block = int(part["block"].iloc[0])
            learned, moved = train_block(
                pa.array(part["text"], pa.large_string()), part["lang"].map(place).to_numpy(), Alphabet(edges), listed,
                start, moves, 1000 * k + block, epochs,
            )
            return pd.DataFrame({"n": [len(part)], "w": [learned.astype(np.float32).tobytes()], "s": [moved.tobytes()]})

        learned = sample.groupBy("block").applyInPandas(block_step, "n long, w binary, s binary").orderBy("n", "w").collect()
        total = sum(r["n"] for r in learned)
        weights = sum(np.frombuffer(r["w"], np.float32).reshape(weights.shape) * np.float32(r["n"] / total) for r in learned)
        switch = sum(np.frombuffer(r["s"]).reshape(switch.shape) * (r["n"] / total) for r in learned)
    return Tagger(languages, edges, listed, weights, switch)


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *more)


def classify(
    docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, n_words) of every document."""
    rows = _rows(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_words long"
    if tagger is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"))

    def run(batches):
        alphabet = Alphabet(tagger.edges)
        names = np.array([*tagger.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                w, chance = tagger.tag(part.column("text"), alphabet)
                n = np.diff(w.bounds)
                total = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, axis=0)])
                mean = (total[w.bounds[1:]] - total[w.bounds[:-1]]) / np.maximum(n, 1)[:, None]
                best = np.where(n > 0, mean.argmax(axis=1), len(names) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names[best], pa.string()), pa.array(np.clip(mean.max(axis=1), 0.0, 1.0)), pa.array(n, pa.int64())],
                    names=["id", "lang_pred", "score", "n_words"],
                )

    return rows.mapInArrow(run, schema)


def label_words(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, score, n_words): runs of words of one language, in code points, end exclusive."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        alphabet = Alphabet(tagger.edges)
        names = np.array(tagger.languages, dtype=object)
        for batch in batches:
            for part in tx.slices(batch, "text", SLICE_BYTES):
                w, chance = tagger.tag(part.column("text"), alphabet)
                if not len(w.ids):
                    continue
                state, row = chance.argmax(axis=1), tx.row_of(w.bounds)
                new = np.concatenate(([True], (state[1:] != state[:-1]) | (row[1:] != row[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(state)) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row[first])),
                        pa.array(w.starts[first] - w.offsets[row[first]], pa.int64()),
                        pa.array(w.ends[last] - w.offsets[row[first]], pa.int64()),
                        pa.array(names[state[first]], pa.string()),
                        pa.array(np.add.reduceat(chance.max(axis=1), first) / (last - first + 1)),
                        pa.array(last - first + 1, pa.int64()),
                    ],
                    names=["id", "start", "end", "lang", "score", "n_words"],
                )

    return rows.mapInArrow(run, f"id {kind}, start long, end long, lang string, score double, n_words long")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the rows that are not held out, then ``classify`` all."""
    taught = _rows(docs, id_col, text_col, docs[lang_col].cast("string").alias("lang"))
    return classify(docs, fit(taught, **options), id_col, text_col)
