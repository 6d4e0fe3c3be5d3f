"""Licence scan and personal data against plain Python over small fixtures."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strayfinder.llm import licenses, pii

SCHEMA = "doc_id bigint, text string, n_words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENCES = [
    (1, "Released under the MIT License."),
    (2, "x CC BY-NC 4.0 cc by, cc  BY. All rights reserved"),
    (3, "General Public\nLicense general public license"),
    (4, None),
    (5, ""),
    (6, "mit und by and is all"),
    (7, "Licensed under the Apache License, Version 2.0."),
    (7, "Licensed under the Apache License, Version 2.0."),
    (8, "apache ate the license under a version 2 tree"),
    (9, "Écc by été " + "wort " * 3000 + "licensed under cc by nc 4 0"),
    (None, "all rights reserved"),
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_and_templates(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in LICENCES], SCHEMA)
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(LICENCES)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == sorted((str(i), *base(t)) for i, t in LICENCES)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[1] == "mit" and labels[7] == "apache-2.0" and labels[2] == "cc-by,cc-by-nc,reserved"
    assert labels[6] == labels[8] == labels[4] == "" and labels[9] == "cc-by,cc-by-nc"
    assert all(0 <= r.score <= 1 for r in rows)
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_license_in_every_file(spark, number):
    label, text, _ = licenses.TEMPLATES[number]
    for n in (1, 5):
        docs = spark.createDataFrame([(k, f"{text}. File {k}", None) for k in range(n)], SCHEMA)
        rows = licenses.scan(docs).collect()
        assert len(rows) == n
        assert all(label in r.labels.split(",") and r.score > 0.99 for r in rows)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def spans(text):
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text or "")
        if fits(kind, m.group())
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


PRIVATE = [
    "mail a.b+c@x-y.example.com, a@b.c_d@e.f, x@y, @z.com; a@b.c@d.e",
    "é\U0001f600 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.0.0.255 1.2.3 99999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 1 2 3",
    "+1 (988) 555-2485 +12 +1234567890123456 call +49.30.901820 now +1 ((((5",
    "1 " * 6000,
    "9" * 20000 + " " + "a." * 9000 + "@" + "b." * 9000,
    "+1" + " " * 9000,
    None,
    "",
    "a@b.co 10.0.0.1 +1 234 567 8901",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(PRIVATE)], SCHEMA)
    rows = {r.doc_id: r for r in pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("b"), pii.number("ip").alias("ip")).collect()}
    for k, text in enumerate(PRIVATE):
        assert rows[k].b == spans(text), text[:80]
        assert rows[k].ip == spans(text).count("ip:")
    assert pii.find(docs.limit(0)).count() == 0


def corpus():
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(400)]
    filler = [re.sub("[0-9]", "q", w) for w in filler]
    say = lambda k, n: " ".join(filler[(k * 7 + j * (k + 3)) % 400] for j in range(n))
    docs = [f"{say(k, 6)} zorblax {say(k + 50, 2)} jane@corp.example {say(k + 90, 6)}" for k in range(6)]
    docs += [f"{say(k + 9, 8)} the office {say(k, 3)} bob{k}@corp.example the {say(k, 5)}" for k in range(12)]
    docs += [f"zorblax stood alone {say(77, 5)}"]
    docs += [f"copied words around carol@corp.example stay as they are {say(5, 9)}"] * 9
    docs += [say(k + 20, 30) for k in range(60)]
    return docs


def test_revealing_terms(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for k, text in enumerate(texts):
        named = {text[s.start : s.end] for s in rows[k] if s.kind.startswith("term")}
        assert named == ({"zorblax"} if "zorblax" in text else set()), text
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, length_col=None).collect()}
    assert not any("zorblax" in t or "@" in t for t in clean.values())
    assert clean[len(texts) - 1] == texts[-1] and "[EMAIL]" in clean[0]


def found_terms(spark, texts):
    """Per text the words that count as revealing terms."""
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    rows = pii.find(docs).collect()
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind.startswith("term")} for r in rows}


def prose(k, n):
    """n words of a small vocabulary, other ones for each k."""
    return " ".join("w" + "".join(chr(97 + int(d)) for d in hashlib.md5(f"{k} {j}".encode()).hexdigest()[:8] if d.isdigit())[:2] for j in range(n))


@pytest.mark.parametrize("form", [
    "{a} zorblax jane@corp.example {b}", "{a} jane@corp.example zorblax {b}", "{a} zorblax, +1 234 567 8901 {b}",
    "zorblax jane@corp.example {b}", "{a} jane@corp.example zorblax",
])
def test_adjacent_name(spark, form):
    texts = [form.format(a=prose(k, 9), b=prose(k + 1000, 9)) for k in range(4)] + [prose(k, 30) for k in range(2000, 2060)]
    got = found_terms(spark, texts)
    assert all(got[k] == ({"zorblax"} if k < 4 else set()) for k in got)


def test_two_word_name(spark):
    texts = [f"{prose(k, 9)} jane doe <jd@corp.example> {prose(k + 1000, 9)}" for k in range(5)]
    texts += [prose(k, 30) for k in range(2000, 2060)]
    got = found_terms(spark, texts)
    assert all(got[k] == ({"jane", "doe"} if k < 5 else set()) for k in got)


def test_entity_with_thousands_of_mentions(spark):
    texts = [f"{prose(k, 7)} zorblax {prose(k + 10_000, 1)} jane@corp.example {prose(k + 20_000, 7)} {k}" for k in range(3000)]
    texts += [prose(k, 30) for k in range(40_000, 46_000)]
    got = found_terms(spark, texts)
    assert all(got[k] == ({"zorblax"} if k < 3000 else set()) for k in got)


def test_near_copies_are_one_mention(spark):
    words = f"a passage about zorblax that people send around with carol@corp.example inside it {prose(1, 20)}".split()
    texts = [" ".join(words[:k] + [f"edit{chr(97 + k)}"] + words[k + 1 :]) for k in range(len(words)) if "@" not in words[k]] * 2
    texts += [prose(k, 30) for k in range(2000, 2060)]
    assert not any(found_terms(spark, texts).values())


def test_sanitise_keeps_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.co x +1 234 567 8901", "s", 24), (2, None, None, None), (3, "", "s", 0), (4, "plain", "s", 5)],
        "doc_id bigint, text string, spans_ string, n_chars bigint",
    )
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert out[1].text == "[EMAIL] x [PHONE]" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and out[4].n_chars == 5 and out[1].spans_ == "s"


@pytest.mark.parametrize("value", ["4111111111111111", "4111-1111-1111-1111"])
def test_hash_of_spans(spark, value):
    docs = spark.createDataFrame([(1, f"x {value}", None)], SCHEMA)
    got = pii.find(docs).select(F.sha2(pii.written(F.col("base")), 256).alias("h")).first().h
    assert got == hashlib.sha256(f"card:2:{2 + len(value)}".encode()).hexdigest()


def test_many_spans_and_words_in_one_text(spark):
    many = " ".join(f"é user{k}@mail{k}.com" for k in range(20_000))
    named = " ".join(["zorblax"] + [f"é{prose(k, 1)}" for k in range(20_000)] + ["zorblax"])
    texts = [f"{prose(k, 9)} zorblax jane@corp.example {prose(k + 1000, 9)}" for k in range(4)] + [many, named]
    texts += [prose(k, 30) for k in range(2000, 2060)]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in pii.find(docs).where("doc_id in (4, 5)").collect()}
    assert [(s.start, s.end) for s in rows[4].base] == [m.span() for m in re.finditer(r"[^ ]+@[^ ]+", many)]
    assert [(s.start, s.end) for s in rows[5].spans] == [(0, 7), (len(named) - 7, len(named))]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, length_col=None).where("doc_id in (4, 5)").collect()}
    assert clean[4] == re.sub(r"[^ ]+@[^ ]+", "[EMAIL]", many)
    assert clean[5] == named.replace("zorblax", "[TERM]")
