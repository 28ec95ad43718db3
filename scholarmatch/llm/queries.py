"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmatch.llm import ann, bpe, collocations, exact_dedup, langid, line_labels, lm_score, minhash, mixing, pii, secret_scan, warc, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).drop("bucket")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_schedule(_read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("t")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_index(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_rows(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_read(spark, sf_dir, "documents"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_labels.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null beyond 64 bits, where only the operator's decimal has it


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_ann_search": op6_ann_search,
    "op7_pii": op7_pii,
    "op9_warc": op9_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_line_quality": op11_line_quality,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

_OP8 = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP10 = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), w AS (
  SELECT source, n, pow(n::DOUBLE, 0.5) / sum(pow(n::DOUBLE, 0.5)) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS part FROM counts
), sh AS (
  SELECT source, n, greatest(1, round(part * 1152921504606846976)::BIGINT)::HUGEINT AS k, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM w
), ks AS (
  SELECT list(k ORDER BY idx) AS k, list(((n + 15) // 16)::BIGINT ORDER BY idx) AS n, sum(k)::HUGEINT AS q FROM sh
), edf AS (
  SELECT 0::BIGINT AS t, list_transform(k, lambda x: 0::BIGINT) AS a, NULL::STRUCT(d HUGEINT, i BIGINT, j BIGINT, r HUGEINT, t BIGINT) AS p FROM ks
  UNION ALL
  SELECT p2.t + 1, list_transform(range(len(k)), lambda i: (CASE WHEN i = p2.i THEN a[i + 1] + 1 ELSE a[i + 1] END)::BIGINT), p2
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(len(k)), lambda i: a[i + 1] < n[i + 1] AND a[i + 1] * q // k[i + 1] <= t2),
             lambda i: {'d': (((a[i + 1] + 1) * q + k[i + 1] - 1) // k[i + 1])::HUGEINT, 'i': i::BIGINT, 'j': a[i + 1]::BIGINT, 'r': (a[i + 1] * q // k[i + 1])::HUGEINT, 't': t2::BIGINT})) AS p2
    FROM (
      SELECT edf.t, edf.a, ks.k, ks.n, ks.q, greatest(t, list_min(list_transform(list_filter(range(len(k)), lambda i: a[i + 1] < n[i + 1]), lambda i: a[i + 1] * q // k[i + 1]))) AS t2
      FROM edf, ks WHERE list_sum(a) < list_sum(n)
    )
  )
), num AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS nth FROM documents
)
SELECT num.doc_id, num.source, round(sh.k / ks.q::DOUBLE, 9) AS weight, nth // 16 AS block, p.r::BIGINT AS release, p.d::BIGINT AS deadline, p.t AS slot, nth % 16 AS "offset"
FROM num JOIN sh ON num.source IS NOT DISTINCT FROM sh.source, ks, edf WHERE edf.p.i = sh.idx AND edf.p.j = nth // 16
"""

_OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

_OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
), o AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (
  SELECT lang, words[i : i + k - 1] AS words, k FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words)
), n AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, words, k, count(*) AS f FROM g GROUP BY lang, words, k HAVING count(*) >= 100
), c AS (
  SELECT f.lang, f.words, f.k, f.f AS a, l.f AS l, r.f AS r, n.n, j, 1000::HUGEINT * f.f * n.n // (l.f::HUGEINT * r.f) AS score
  FROM f, (SELECT unnest(range(1, 5)) AS j), f AS l, f AS r, n
  WHERE f.k > 1 AND j < f.k AND l.lang = f.lang AND r.lang = f.lang AND n.lang = f.lang AND l.words = f.words[1 : j] AND r.words = f.words[j + 1 : f.k]
), s AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), sub AS (
  SELECT s.lang, s.words[b : b + z - 1] AS words, max(s.a) AS most
  FROM s, (SELECT unnest(range(1, 5)) AS b), (SELECT unnest(range(2, 5)) AS z) WHERE z < s.k AND b + z - 1 <= s.k GROUP BY ALL
), ranked AS (
  SELECT s.lang, array_to_string(s.words, ' ') AS phrase, a, l, r, n, score FROM s LEFT JOIN sub ON s.lang = sub.lang AND s.words = sub.words
  WHERE sub.most IS NULL OR 100 * sub.most < 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""

ORACLES = {
    "op13_collocations": _OP13,
    "op9_warc": _OP9,
    "op8_exact_dedup": _OP8,
    "op10_mix_sources": _OP10,
}
