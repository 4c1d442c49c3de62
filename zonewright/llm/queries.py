"""The corpus operators applied to their whole tables, and the SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    decontamination,
    divergence,
    language_id,
    license_scan,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_archive,
    token_counts,
    tokens,
)
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scan_licences(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "licence", F.round("dice", 9).alias("dice"), F.array_join("licences", ",").alias("licences"), F.size("blocks").cast("long").alias("n_blocks"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.word_bpe_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", F.col("_zw_n_lines").alias("n_lines"), F.col("_zw_n_removed").alias("n_removed"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), tokens.word_bpe_path(), end_id=49407)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_archive.archived_token_counts(table(spark, sf_dir, "documents"), tokens.word_bpe_path(), end_id=2)
    return got.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "ordinal")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_token_archive": op11_token_archive,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_bare
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * (n_upper + n_lower)
            OR 10 * n_dup_lines > 6 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * n_bare > 3 * n_words) AS kept
FROM b
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS g
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN iw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP6 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS s, trim(x, ' ') AS a, lead(trim(x, ' ')) OVER o AS b, lead(trim(x, ' '), 2) OVER o AS c, lead(i, 2) OVER o + 1 AS e
      FROM l WHERE trim(x, ' ') <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, s) AS n FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM k WHERE n > 1),
r AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE g.i IS NULL) AS t, count(*) AS n_lines, count(g.i) AS n_removed
      FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN r USING (doc_id)
"""

#: Damage by crc32 (a table by its rule, then byte by byte); then backwards over rows the cheapest, least edits from each of four
#: states, each with its cost, audit and repaired rows.
_OP12 = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crcs
                       FROM range(256) AS x(b)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
f AS (SELECT *, xor(list_reduce(list_transform(key, lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)]),
                                CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault FROM k, tab),
m AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
e AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS kind,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, left(role, 1) AS r,
             count(*) OVER (PARTITION BY conv_id) AS n FROM o),
x AS (SELECT *, CASE kind WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1099511627776 END AS more FROM e),
best AS (
  SELECT conv_id, n + 1 AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS s0,
         {'c': CAST(6 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']} AS s1,
         {'c': CAST(3 AS BIGINT), 'a': 'I', 't': ['assistant:']} AS s2, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS s3
  FROM x WHERE i = 1
  UNION ALL
  SELECT conv_id, i,
         list_min([w0, {'c': 3 + w2.c, 'a': 'I' || w2.a, 't': ['user:'] || w2.t}, {'c': 6 + w3.c, 'a': 'II' || w3.a, 't': ['user:', 'assistant:'] || w3.t}]),
         list_min([w1, {'c': 3 + w2.c, 'a': 'I' || w2.a, 't': ['user:'] || w2.t}, {'c': 6 + w3.c, 'a': 'II' || w3.a, 't': ['user:', 'assistant:'] || w3.t}]),
         list_min([w2, {'c': 3 + w3.c, 'a': 'I' || w3.a, 't': ['assistant:'] || w3.t}]),
         list_min([w3, {'c': 3 + w2.c, 'a': 'I' || w2.a, 't': ['user:'] || w2.t}])
  FROM (SELECT b.conv_id, x.i,
         list_min([{'c': 4 + s0.c, 'a': 'D' || s0.a, 't': s0.t},
                   {'c': CASE r WHEN 's' THEN s1.c WHEN 'u' THEN s2.c ELSE 1099511627776 END + more, 'a': 'K' || CASE r WHEN 's' THEN s1.a ELSE s2.a END,
                    't': [role || ':' || text] || CASE r WHEN 's' THEN s1.t ELSE s2.t END},
                   {'c': 3 + more + s2.c, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t}]) AS w0,
         list_min([{'c': 4 + s1.c, 'a': 'D' || s1.a, 't': s1.t},
                   {'c': CASE r WHEN 'u' THEN s2.c ELSE 1099511627776 END + more, 'a': 'K' || s2.a, 't': [role || ':' || text] || s2.t},
                   {'c': 3 + more + s2.c, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t}]) AS w1,
         list_min([{'c': 4 + s2.c, 'a': 'D' || s2.a, 't': s2.t},
                   {'c': CASE r WHEN 'a' THEN s3.c ELSE 1099511627776 END + more, 'a': 'K' || s3.a, 't': [role || ':' || text] || s3.t},
                   {'c': 3 + more + s3.c, 'a': 'R' || s3.a, 't': ['assistant:' || text] || s3.t}]) AS w2,
         list_min([{'c': 4 + s3.c, 'a': 'D' || s3.a, 't': s3.t},
                   {'c': CASE r WHEN 'u' THEN s2.c ELSE 1099511627776 END + more, 'a': 'K' || s2.a, 't': [role || ':' || text] || s2.t},
                   {'c': 3 + more + s2.c, 'a': 'R' || s2.a, 't': ['user:' || text] || s2.t}]) AS w3
        FROM best b JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i - 1)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'b') AS blank,
             count(*) FILTER (WHERE kind = 'd') AS duplicate, count(*) FILTER (WHERE kind = 't') AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) + 5 * coalesce(v, 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT lang, g.source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // total AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
      FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q AS BIGINT) FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""

SQL: dict[str, str] = {
    "op4_decontamination": _OP4,
    "op5_quality_rules": _OP5,
    "op6_line_dedup": _OP6,
    "op12_conversation_repair": _OP12,
    "op13_source_divergence": _OP13,
}
