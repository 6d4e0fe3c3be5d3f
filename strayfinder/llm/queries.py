"""One query per operator, over whole tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfinder.llm import (
    decontamination, jaccard, language, licenses, merkle, mixing, pii, quality_model, quality_rules, suffix_dedup,
    toxicity, warc, whitening,
)
from strayfinder.llm.calibration import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_ngram_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
    ), reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    )
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
    """,
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.classes(table(spark, sf, "documents"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf, "documents"))


@query("op3_mix_sources")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query(
    "op4_warc_roundtrip",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
    ), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)),
             'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (h)
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf, "pages"))


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return judged(quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels")), 0.3)


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return judged(toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")), 0.5)


@query("op7_license_scan")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query("op8_pii")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"))
    counts = [pii.number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query("op9_decontaminate")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op10_quality_rules",
    r"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), windows AS (
      SELECT doc_id, i, ws[i:i + 4] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
    ), twice AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
    ), covered AS (
      SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(5) t(d) GROUP BY doc_id
    ), lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
    ), dups AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ), m AS (
      SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(dups.n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks
      FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
                OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines) OR 2 * n_upper > word_chars
                OR 5 * n_marks > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
    FROM m
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails(F.col("bits"), quality_rules.BASE).alias("base_failed"),
        (~quality_rules.fails(F.col("bits"), quality_rules.V2)).alias("kept"),
    )


@query(
    "op11_merkle_manifest",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, n_chars,
             CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
             || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
             || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
             CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
             xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
               lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda i: i::BIGINT),
                 lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
      FROM documents
    ), l AS (
      SELECT doc_id, lang,
             sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
             sha256(head || CASE WHEN n_chars IS NULL THEN '-' WHEN crc % 7 = 0 THEN strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)
                                 ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS altered
      FROM d
    ), p AS (
      SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
      FROM l
    ), up AS (
      SELECT g, 0 AS lvl, pos, leaf AS h, n FROM p
      UNION ALL
      SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up
      WHERE n > 1 GROUP BY g, lvl, pos // 2, n
    ), subs AS (SELECT g, h AS subroot, count(*) OVER () AS n FROM up WHERE n = 1
    ), top AS (
      SELECT 0 AS lvl, g - 1 AS pos, subroot AS h, n FROM subs
      UNION ALL
      SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top
      WHERE n > 1 GROUP BY lvl, pos // 2, n
    ), steps AS (
      SELECT p.g, p.pos, s.lvl, (p.pos >> s.lvl) & 1 = 1 AS is_right, coalesce(u.h, '') AS h
      FROM p JOIN (SELECT DISTINCT g, lvl FROM up WHERE n > 1) s ON s.g = p.g
      LEFT JOIN up u ON u.g = p.g AND u.lvl = s.lvl AND u.pos = xor(p.pos >> s.lvl, 1)
      UNION ALL
      SELECT p.g, p.pos, 1000 + s.lvl, ((p.g - 1) >> s.lvl) & 1 = 1, coalesce(u.h, '')
      FROM p CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) s
      LEFT JOIN top u ON u.lvl = s.lvl AND u.pos = xor((p.g - 1) >> s.lvl, 1)
    ), paths AS (
      SELECT g, pos, sha256(string_agg(h, '' ORDER BY lvl)) AS proof,
             list(CASE WHEN is_right THEN 'L' ELSE 'R' END || h ORDER BY lvl) AS path
      FROM steps GROUP BY g, pos
    ), f AS (
      SELECT p.doc_id, p.leaf, subs.subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(paths.proof, sha256('')) AS proof_sha256,
             list_reduce([p.altered] || coalesce(paths.path, []), lambda a, s: sha256(
               CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
      FROM p JOIN subs ON subs.g = p.g LEFT JOIN paths ON paths.g = p.g AND paths.pos = p.pos
    )
    SELECT *, folded_root = root AS verified FROM f
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # one decimal digit more than a long has, so the last one can be counted up too
    added = docs["n_chars"].cast("decimal(20,0)") + F.when(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, 1).otherwise(0)
    proofs = merkle.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": added.cast("decimal(20,0)")}
    ).withColumn("folded_root", merkle.folded(F.col("altered"), F.col("path")))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op13_language_id")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = language.identify(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "n_words")
