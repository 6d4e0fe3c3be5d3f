"""Licence scan by a positional index of rare tokens; DataFrame functions only.

Templates are short licence texts with a mandatory key phrase. Their words are postings (word,
template, position). Document frequencies over all files give each licence word its IDF, which is 1 for
a word that every file holds and more for others. The licence words of a file are looked up in the
postings, and places agree when file position minus template position is the same. An offset is a
candidate when a word agrees there that is rare (IDF at least ``RARE`` of the template's highest); the
template is found when the agreeing words carry ``SHARE`` of its weight and every word of its mandatory
key phrase stands there.
Beside that, the base phrases are counted wherever their words stand consecutively.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned
each on its own; texts of any length are scanned whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strayfinder.session import durable

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.6
RARE = 0.7

#: fixed values: phrase and label
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: fixed values: label, licence text, key phrase in it
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by", "gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution", "creative commons attribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
)
#: words that never get a posting unless a key phrase needs them
COMMON = frozenset("a and any as by in is of or the to under use with without 0 2 3 4".split())


def _postings() -> list[tuple[int, str, str, int, bool, int]]:
    """(template, label, word, position, in the key phrase, words of the key phrase)."""
    out = []
    for number, (label, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        begin = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        for k, word in enumerate(words):
            inside = begin <= k < begin + len(key)
            if inside or word not in COMMON:
                out.append((number, label, word, k, inside, len(key)))
    return out


POSTINGS = _postings()
VOCABULARY = sorted({p[2] for p in POSTINGS} | {w for phrase, _ in BASE for w in phrase.split()})
#: words of ordinary prose; every phrase and key phrase has another word beside these
PROSE = frozenset("all and by is mit".split())
ANCHORS = [w for w in VOCABULARY if w not in PROSE]


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per file: id, n_words, its distinct licence words and, if one is no prose word, all their places."""
    words = F.regexp_extract_all(F.lower(F.coalesce(docs[text_col], F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(docs[id_col].alias("id"), words.alias("words")).withColumn(
        "found", F.array_intersect("words", _strings(VOCABULARY))
    )
    placed = F.transform("words", lambda w, k: F.struct(w.alias("w"), k.cast("long").alias("at")))
    hits = F.filter(placed, lambda x: x["w"].isin(VOCABULARY))
    return rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        "found",
        F.when(F.arrays_overlap("found", _strings(ANCHORS)), hits).alias("hits"),
        F.monotonically_increasing_id().alias("row"),
    )


def _places(word: str, back: int) -> Column:
    return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["at"] - back)


def _starts(phrase: str) -> Column:
    """Places where the words of ``phrase`` stand consecutively."""
    first, *rest = (_places(word, k) for k, word in enumerate(phrase.split()))
    for places in rest:
        first = F.array_intersect(first, places)
    return F.coalesce(first, F.array().cast("array<bigint>"))


def frequencies(files: DataFrame) -> dict[str, float]:
    """IDF of every licence word, counted over all files; as many values as the vocabulary has words."""
    counted = files.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {row["word"]: row["df"] for row in counted.collect()}
    n = files.count()
    return {word: 1 + math.log((n + 1) / (df.get(word, 0) + 1)) for word in VOCABULARY}


def index(idf: dict[str, float]) -> Column:
    """The postings with their weights as an array literal; rare words are near a template's highest IDF."""
    full: dict[int, float] = {}
    top: dict[int, float] = {}
    for template, _, word, *_ in POSTINGS:
        full[template] = full.get(template, 0.0) + idf[word]
        top[template] = max(top.get(template, 0.0), idf[word])
    return F.array(*(
        F.struct(
            F.lit(template).alias("template"), F.lit(label).alias("label"), F.lit(word).alias("word"),
            F.lit(at).alias("tpos"), F.lit(key).alias("key"), F.lit(words).alias("key_words"),
            F.lit(idf[word]).alias("idf"), F.lit(full[template]).alias("full"),
            F.lit(idf[word] >= RARE * top[template]).alias("rare"),
        )
        for template, label, word, at, key, words in POSTINGS
    ))


def found_templates(files: DataFrame) -> DataFrame:
    """(row, label, at, share): templates of the index that stand in the files."""
    postings = files.sparkSession.range(1).select(F.explode(index(frequencies(files))).alias("p")).select("p.*")
    places = files.select("row", F.explode("hits").alias("h")).select(
        "row", F.col("h.w").alias("word"), F.col("h.at").alias("at")
    )
    # one group per file, template and relative position; only those with a rare word are candidates
    agreeing = (
        places.join(F.broadcast(postings), "word")
        .groupBy("row", "template", "label", "key_words", "full", (F.col("at") - F.col("tpos")).alias("offset"))
        .agg(
            F.sum("idf").alias("weight"),
            F.count_if("key").alias("n_key"),
            F.count_if("rare").alias("n_rare"),
        )
    )
    share = F.col("weight") / F.col("full")
    return agreeing.where(
        (F.col("n_rare") > 0) & (F.col("n_key") == F.col("key_words")) & (share >= SHARE)
    ).select("row", "label", F.col("offset").alias("at"), share.alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: word count, base phrases, labels and the share of the best template."""
    files = durable(tokens(docs, id_col, text_col))
    matched = found_templates(files).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("best"), F.count("*").alias("n_templates")
    )
    starts = [_starts(phrase) for phrase, _ in BASE]
    base = F.array_compact(F.array(*(F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, BASE))))
    rows = files.withColumns({"starts": F.concat(*starts), "base": base}).join(matched, "row", "left")
    labels = F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.coalesce("n_templates", F.lit(0)).alias("n_templates"),
    )
