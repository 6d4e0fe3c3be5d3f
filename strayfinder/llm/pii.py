"""Personal data and the terms that give it away; DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. Every value found
is a protected entity. The corpus then tells how strongly a term reveals one: of the texts that hold
the term, the share in which it stands near that entity, an estimate of P(entity | term), and the
information this gains about the entity, log P(entity | term) / P(entity). A term counts when
``MENTIONS`` independent texts hold it beside the entity: the words around the entity in them, within
``WIDE``, have at most half of their union in common for any two, so copies and near copies of one text count
once, and neither the place of the term nor the number of mentions matters. Terms above ``DISCLOSE``
are generalised, those above ``REMOVE`` are removed, wherever they stand, also in texts without the
entity.

The patterns run over all texts twice, once to count and once for the result. Places are running lengths
by doubling steps and windows are byte slices, so a text of n spans or words takes n log n steps.

Defined results: null and empty texts have no span; repeated rows are separate documents but one
mention; texts of any length are read whole; an empty table gives an empty result; other columns are
not read by ``find``, and ``sanitise`` carries them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strayfinder.session import durable

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}

#: code points before and after an entity that are near it
NEAR = 80
#: code points before and after an entity whose words tell independent texts from copies
WIDE = 240
MENTIONS = 3
DISCLOSE, REMOVE = 0.5, 0.9
#: share of an entity's information, log 1 / P(entity), that a term must give
INFORMED = 0.5
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMALL_ROWS = 200_000
#: the same for rows that hold the words of a window
LEADERS = 20_000


NO_SPANS = "array<struct<start:bigint,end:bigint,value:string,kind:string,at:bigint,to:bigint>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, join) -> Column:
    """Running totals of an array by doubling steps: n log n work, where appending would take n squared."""
    last = F.size(values) - 1
    steps = F.when(last >= 1, F.sequence(F.lit(0), F.floor(F.log2(last.cast("double"))).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def step(held: Column, j: Column) -> Column:
        far = F.pow(F.lit(2.0), j).cast("int")
        return F.transform(held, lambda x, k: F.when(k >= far, join(x, F.get(held, k - far))).otherwise(x))

    return F.aggregate(steps, values, step)


def _spans(text: Column, pattern: str | Column, kind: Column | str, guard: Column) -> Column:
    """array<struct<start, end, value, kind, at, to>> of all matches: places in code points and in bytes.

    The pieces between matches and the matches themselves alternate, so places are running lengths.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = F.lit(kind) if isinstance(kind, str) else kind
    gaps = F.split(text, pattern, F.lit(-1))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit")),
        lambda x: F.struct(
            x["hit"].alias("hit"), F.length(x["hit"]).cast("bigint").alias("long"), F.octet_length(x["hit"]).cast("bigint").alias("wide"),
            (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint").alias("end"),
            (F.octet_length(x["gap"]) + F.coalesce(F.octet_length(x["hit"]), F.lit(0))).cast("bigint").alias("to"),
        ),
    )
    added = lambda x, y: F.struct(
        x["hit"].alias("hit"), x["long"].alias("long"), x["wide"].alias("wide"),
        (x["end"] + y["end"]).alias("end"), (x["to"] + y["to"]).alias("to"),
    )
    placed = F.filter(_bound(sizes, lambda held: _running(held, added)), lambda x: x["hit"].isNotNull())
    walked = F.transform(placed, lambda x: F.struct(
        (x["end"] - x["long"]).alias("start"), x["end"].alias("end"), x["hit"].alias("value"), kind.alias("kind"),
        (x["to"] - x["wide"]).alias("at"), x["to"].alias("to"),
    ))
    return F.when(guard, walked).otherwise(F.array().cast(NO_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _parts_fit(value: Column) -> Column:
    """Every part is at most 255, whatever zeros lead it."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))


def _luhn(value: Column) -> Column:
    """Every second digit from the right counts double, its digits added; the sum ends in 0."""
    reversed_digits = F.split(F.reverse(_digits(value)), "")
    counted = F.transform(
        F.filter(reversed_digits, lambda d: d != ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(counted, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base matches by start, then kind as listed."""
    email = _spans(text, EMAIL, "email", F.contains(text, F.lit("@")))
    dotted = F.filter(_spans(text, IP, "ip", F.rlike(text, F.lit(r"[0-9]\.[0-9]"))), lambda s: _parts_fit(s["value"]))
    card = F.filter(
        _spans(text, CARD, "card", F.rlike(text, F.lit(r"(?:[0-9][\x20-]?){11}[0-9]"))),
        lambda s: F.length(_digits(s["value"])).between(12, 19) & F.when(F.length(s["value"]) < 64, _luhn(s["value"])),
    )
    phone = F.filter(
        _spans(text, PHONE, "phone", F.contains(text, F.lit("+"))),
        lambda s: F.length(_digits(s["value"])).between(9, 15),
    )
    return _ordered(F.concat(email, dotted, card, phone))


def _ordered(spans: Column) -> Column:
    place = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(place, F.split_part(s["kind"], F.lit("/"), F.lit(1))).alias("order"),
        s["end"].alias("end"), s["value"].alias("value"), s["kind"].alias("kind"), s["at"].alias("at"), s["to"].alias("to"),
    ))
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.split_part(s["kind"], F.lit("/"), F.lit(1)), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(kind: str) -> Column:
    """Base spans of one kind in a result of ``find``."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def evidence(rows: DataFrame) -> DataFrame:
    """(copy, entity, left, right, before, after): what stands around every span, at most ``WIDE`` code points.

    ``before`` and ``after`` count what the text holds there in all. A text without spans has one row with
    a null entity. Windows are cut from the bytes, where any place is reached at once, so a text of many
    spans is not walked for each; a code point has at most four bytes.
    """
    raw = F.struct(F.col("text").cast("binary").alias("raw"), F.length("text").alias("n"))
    # the last WIDE code points in front of a span; a code point that the cut splits is not among them
    cut = lambda t, s: F.substring(t["raw"], F.greatest(s["at"] - 4 * WIDE, F.lit(0)).cast("int") + 1,
                                   F.least(s["at"], F.lit(4 * WIDE)).cast("int"))
    around = _bound(raw, lambda t: F.transform("spans", lambda s: F.struct(
        _entity(s).alias("entity"),
        F.right(cut(t, s).cast("string"), F.lit(WIDE)).alias("left"),
        F.substring(F.substring(t["raw"], s["to"].cast("int") + 1, F.lit(4 * WIDE)).cast("string"), 1, WIDE).alias("right"),
        s["start"].alias("before"), (t["n"] - s["end"]).alias("after"),
    )))
    return rows.select("copy", F.explode_outer(F.when(F.size("spans") > 0, around)).alias("e")).select("copy", "e.*")


def _around(width: int) -> Column:
    """Distinct words at most ``width`` code points before or after a row of ``evidence``."""
    left, right = F.right("left", F.lit(width)), F.substring("right", 1, width)
    # a word that the border of the window cuts is left out
    left = F.when(F.col("before") > width, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(F.col("after") > width, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return F.array_union(_words(left), _words(right))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def mentions(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, copy, terms, context): words near an entity and hashes of those in the wider window, per text."""
    near = found.join(_small(entities), "entity").select(
        "entity", "copy", _around(NEAR).alias("terms"), F.transform(_around(WIDE), lambda w: F.xxhash64(w)).alias("context")
    )
    return near.groupBy("entity", "copy").agg(
        *(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("terms", "context"))
    )


def independent(pairs: DataFrame) -> DataFrame:
    """(entity, term) with ``MENTIONS`` independent texts among ``pairs`` (entity, term, copy, context).

    Each pass sets one text aside and leaves those that are no copies of it.
    """
    rest = pairs.where(F.size("context") > 0)
    for k in range(MENTIONS - 1):
        first = durable(rest.groupBy("entity", "term").agg(F.min_by("context", "copy").alias("first")))
        common = F.size(F.array_intersect("context", "first"))
        rest = rest.join(_small(first, LEADERS), ["entity", "term"]).where(
            3 * common <= F.size("context") + F.size("first")
        ).drop("first")
    return rest.select("entity", "term").distinct()


def _small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast when the rows are few; otherwise the join shuffles."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def revealing(rows: DataFrame) -> DataFrame | None:
    """(term, entity, p, bits, action) of the terms over the thresholds, None when there is none.

    ``rows`` has text, copy (a hash of the text, which copies share) and spans.
    """
    found = durable(evidence(rows))  # the patterns run over the texts once; all counts come from here
    holders = durable(
        found.where(F.col("entity").isNotNull()).groupBy("entity").agg(F.countDistinct("copy").alias("holders")).where(F.col("holders") >= MENTIONS)
    )
    if holders.isEmpty():
        return None
    near = durable(mentions(found, holders.select("entity")))
    each = near.select("entity", "copy", "context", F.explode("terms").alias("term"))
    often = durable(each.groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= MENTIONS))
    # the term itself is in all its contexts
    others = F.array_remove("context", F.xxhash64("term"))
    pairs = each.join(_small(often.select("entity", "term")), ["entity", "term"]).withColumn("context", others)
    likely = durable(often.join(_small(durable(independent(pairs))), ["entity", "term"]))
    terms = likely.select("term").distinct()
    if likely.isEmpty():
        return None
    texts = rows.select("copy", "text").where(F.length("text") > 0)
    spread = (
        texts.select("copy", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        .join(_small(terms), "term")
        .groupBy("term")
        .agg(F.countDistinct("copy").alias("total"))
    )
    corpus = found.agg(F.countDistinct("copy")).first()[0]
    p = F.col("n") / F.col("total")
    judged = (
        likely.join(spread, "term").join(holders, "entity")
        .withColumns({"p": p, "whole": F.log2(F.lit(float(corpus)) / F.col("holders"))})
        .withColumn("bits", F.col("whole") + F.log2("p"))
    )
    strong = judged.where((F.col("p") >= DISCLOSE) & (F.col("bits") > 0) & (F.col("bits") >= INFORMED * F.col("whole")))
    best = durable(strong.groupBy("term").agg(
        F.max("p").alias("p"), F.max("bits").alias("bits"), F.max_by("entity", "p").alias("entity")
    ).withColumn("action", F.when(F.col("p") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))))
    return None if best.isEmpty() else best


def _term_spans(text: Column) -> Column:
    """Places of the row's terms as whole words; ``terms`` holds structs (term, action)."""
    every = _spans(F.lower(text), LETTERS, TERM, F.col("terms").isNotNull())
    names = F.transform("terms", lambda t: t["term"])
    kept = F.filter(every, lambda s: F.array_contains(names, s["value"]))
    acted = F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.concat(F.lit(TERM + "/"), F.get(F.col("terms.action"), F.array_position(names, s["value"]).cast("int") - 1)).alias("kind"),
        s["at"].alias("at"), s["to"].alias("to"),
    ))
    return F.when(F.col("terms").isNotNull(), acted).otherwise(F.array().cast(NO_SPANS))


def _found(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``spans_``: base spans and those of revealing terms, by start."""
    body = F.coalesce(text, F.lit(""))
    copy = F.xxhash64(body, F.lit(1))
    with_base = docs.withColumns({"text_": body, "copy_": copy}).withColumn("base_", base_spans(F.col("text_")))
    corpus = with_base.select(F.col("text_").alias("text"), F.col("copy_").alias("copy"), F.col("base_").alias("spans"))
    terms = revealing(corpus)
    if terms is None:
        return with_base.withColumn("spans_", F.col("base_"))
    holders = (
        corpus.select("copy", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        .join(_small(terms.select("term", "action")), "term")
        .groupBy("copy")
        .agg(F.array_sort(F.collect_set(F.struct("term", "action"))).alias("terms"))
    )
    joined = with_base.join(_small(durable(holders)).withColumnRenamed("copy", "copy_"), "copy_", "left")
    plain = F.transform("base_", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["kind"].alias("kind"), s["at"].alias("at"), s["to"].alias("to")))
    return joined.withColumn("spans_", _ordered(F.concat(plain, _term_spans(F.col("text_"))))).drop("terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, order, end, value, kind) per document."""
    rows = _found(docs.select(docs[id_col].alias("id_"), docs[text_col].alias("raw_")), F.col("raw_"))
    return rows.select(F.col("id_").alias(id_col), F.col("base_").alias("base"), F.col("spans_").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by the mask of its kind; overlapping spans share one mask.

    Pieces are cut from the bytes between the furthest end so far and the next start, and joined once.
    """
    masks = F.create_map(*(F.lit(x) for pair in MASKS.items() for x in pair))
    mask = lambda s: F.coalesce(F.element_at(masks, F.substring_index(s["kind"], "/", -1)), F.lit(""))

    def cut(t: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            done = F.when(k > 0, F.get(t["ends"], k - 1)).otherwise(F.lit(0).cast("bigint"))
            between = F.substring(t["raw"], (done + 1).cast("int"), (s["at"] - done).cast("int")).cast("string")
            return F.when(s["at"] >= done, F.concat(between, mask(s))).otherwise(F.lit(""))

        rest = F.substring(t["raw"], (F.element_at(t["ends"], -1) + 1).cast("int"), F.lit(2_147_483_647)).cast("string")
        return F.array_join(F.concat(F.transform(t["spans"], piece), F.array(rest)), "")

    ends = _bound(F.transform(spans, lambda s: s["to"]), lambda held: _running(held, lambda x, y: F.greatest(x, y)))
    folded = _bound(F.struct(text.cast("binary").alias("raw"), spans.alias("spans"), ends.alias("ends")), cut)
    return F.when(F.size(spans) > 0, folded).otherwise(text)


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with masked texts; ``length_col``, if there, is the new length where a text changed."""
    names = docs.columns
    at = names.index(text_col)
    short = docs.toDF(*(f"c{k}" for k in range(len(names))))
    rows = _found(short, F.col(f"c{at}"))
    new = F.when(F.size("spans_") > 0, masked(F.col("text_"), F.col("spans_"))).otherwise(F.col(f"c{at}"))
    changed = {f"c{at}": new}
    if length_col in names:
        k = names.index(length_col)
        changed[f"c{k}"] = F.when(F.size("spans_") > 0, F.length(new).cast(docs.schema[k].dataType)).otherwise(F.col(f"c{k}"))
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in short.columns)).toDF(*names)
