"""The registered queries of the operators for training text, and their check statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import (
    bpe, decontaminate, embeddings, language, licenses, lines, resampling, sharding, simhash, substrings, token_counts,
    toxicity, whitening)
from tidewatch.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

VOCABULARY, WORDS = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check.strip()
        return fn
    return register


@query("op1_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, folder, "documents"))


@query("op2_language")
def language_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


@query("op3_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


@query("op4_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, source, p, ls[p] AS line, trim(ls[p], ' ' || chr(9) || chr(13)) AS body
      FROM (SELECT r, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM d WHERE text IS NOT NULL)),
b AS (SELECT body FROM l WHERE body <> '' GROUP BY body HAVING count(DISTINCT source) >= 10),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE b.body IS NOT NULL) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE b.body IS NULL), '') AS kept
      FROM l LEFT JOIN b USING (body) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


@query("op5_sharding")
def sharding_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op6_decontamination", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               AS lower_ascii FROM documents)),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n,
         unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1),
                               lambda s: array_to_string(ws[s:s + 12], ' '))) AS g
  FROM i WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS s, ws FROM d, lengths WHERE len(ws) >= n),
hits AS (
  SELECT g.r, g.s, g.n, p.item FROM g JOIN p ON p.n = g.n AND p.g = array_to_string(g.ws[g.s:g.s + g.n - 1], ' ')),
covered AS (
  SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS w FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
""")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_embeddings", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT a AS origin, b AS node FROM l UNION SELECT r.origin, l.b FROM reach r JOIN l ON l.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
c AS (SELECT origin AS vec_id, min(node) AS low FROM reach GROUP BY origin)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
""")
def embedding_groups(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@query("op8_toxicity")
def toxicity_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), VOCABULARY)


@query("op10_substrings", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
w AS (
  SELECT r, doc_id, s, array_to_string(ws[s:s + 12], ' ') AS g
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM w JOIN m USING (g) WHERE least < doc_id),
p AS (SELECT r, ws[p] AS word, p FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
k AS (
  SELECT p.r, string_agg(p.word, ' ' ORDER BY p.p) AS kept, count(*) AS n_kept
  FROM p LEFT JOIN c ON c.r = p.r AND c.p = p.p WHERE c.p IS NULL GROUP BY p.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
""")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_report(table(spark, folder, "documents"))


@query("op11_resampling", r"""
WITH remainders AS (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])),
                              lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) bytes(b))),
texts AS (
  SELECT row_number() OVER () AS r, 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), 1, NULL, text FROM benchmark),
split AS (
  SELECT r, side, doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM texts),
words AS (SELECT r, side, unnest(ws) AS w FROM split),
hexes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
octets AS (
  SELECT w, list_transform(range(0, len(h) // 2), lambda i: CAST(
           (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16
           + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS UBIGINT)) AS o
  FROM hexes),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), o),
                            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS b
  FROM octets, remainders),
counts AS (
  SELECT b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t
  FROM words JOIN buckets USING (w) GROUP BY b),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS ss, CAST(coalesce(sum(t), 0) AS DOUBLE) AS tt FROM counts),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s AS DOUBLE) + 1) * (tt + 10000))))
                 AS BIGINT) AS gain
  FROM counts, totals),
sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g
  FROM words JOIN buckets USING (w) JOIN gains USING (b) WHERE side = 0 GROUP BY r),
noise AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS UBIGINT) AS h
  FROM split LEFT JOIN sums USING (r) WHERE side = 0),
scored AS (
  SELECT r, doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM noise),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
""")
def resampled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_token_counts")
def tokens_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_report(table(spark, folder, "documents"), WORDS)


@query("op13_whitening")
def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten_report(table(spark, folder, "embeddings"))
