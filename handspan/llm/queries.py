"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from handspan.llm import decontaminate, hilbert_ann, kneser_ney, mixing, near_dedup, overlap_join, phrases, suffix_dedup, token_counts, token_output, toxicity, warc_fixity, whitening
from handspan.llm.shared import workers_find_library

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.suffix_dedup(docs, 50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER), 1024, keep=["doc_id"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mixture(docs, public_tokenizers.path(TOKENIZER))
    weights = plan.select(F.when(F.col("src") != "null", F.substring("src", 2, 1 << 30)).alias("source"), "weight", "exponent")
    mixed = mixing.mix(docs.drop("text"), plan)
    known = weights.withColumnRenamed("source", "_s")
    return mixed.join(F.broadcast(known) if known.count() <= mixing.HELD_SOURCES else known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def replica_of(pages: DataFrame) -> DataFrame:
    """A second archive of the same pages as a worn disk would give it: some records flipped, cut short, lost or doubled, by their ids."""
    k = F.col("page_id")
    html = F.when(k % 97 == 13, F.concat(F.lit("#"), F.col("html"))).when(k % 131 == 40, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    kept = pages.where(k.isNull() | (k % 211 != 7)).withColumn("html", html)
    return kept.union(kept.where(k % 499 == 3))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(pages, replica_of(pages))


OP4_SQL = r"""
WITH rec AS (
  SELECT page_id AS slot, url, html FROM pages
), size AS (
  SELECT slot, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || slot || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, html,
    CASE WHEN slot % 97 = 13 THEN '#' || html WHEN slot % 131 = 40 THEN left(html, length(html) - 1) ELSE html END AS html_b
  FROM rec
), two AS (
  SELECT slot, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    head || strlen(html_b) || chr(13) || chr(10) || chr(13) || chr(10) || html_b || chr(13) || chr(10) || chr(13) || chr(10) AS b,
    slot % 211 = 7 AS lost, CASE WHEN slot % 499 = 3 THEN 2 ELSE 1 END AS n_b
  FROM size
), leaf AS (
  SELECT slot, strlen(a) AS size, strlen(b) * n_b AS size_b, lost, n_b,
    sha256('1:' || array_to_string(list_transform([0, 1, 2, 3, 4], lambda k: CAST(('0x' || substr(sha256(a), 1 + 12 * k, 12))::UBIGINT::HUGEINT AS VARCHAR)), ':')) AS digest,
    sha256(n_b || ':' || array_to_string(list_transform([0, 1, 2, 3, 4], lambda k: CAST(n_b * ('0x' || substr(sha256(b), 1 + 12 * k, 12))::UBIGINT::HUGEINT AS VARCHAR)), ':')) AS digest_b
  FROM two
), placed AS (
  SELECT *, slot // 4096 AS file, coalesce(sum(size) OVER (PARTITION BY slot // 4096 ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM leaf
)
SELECT slot, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status, file, CAST(off AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, CAST(1 AS BIGINT) AS records,
  CASE WHEN NOT lost THEN CAST(size_b AS BIGINT) END AS replica_size, digest, CASE WHEN NOT lost THEN digest_b END AS replica_digest
FROM placed WHERE lost OR digest <> digest_b
"""


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hilbert_ann.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_output.token_digest(token_output.write_token_shards(docs, public_tokenizers.path(TOKENIZER)))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), order=3)
    scored = kneser_ney.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), 13, 20, keep=["doc_id"])
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 16)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), size AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * ((SELECT n FROM size WHERE size.doc_id = a.doc_id) + (SELECT n FROM size WHERE size.doc_id = b.doc_id) - count(*))
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce((SELECT min(other) FROM reach WHERE reach.doc_id = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN size ON size.doc_id = w.doc_id
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), support=100, longest=5, best=2000, contained=100)


OP13_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY 1
), grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, phrase, k AS words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1
), longer AS (
  SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS held FROM c, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i + m - 1 <= words AND m < words GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, i AS k, l.a AS l, r.a AS r, n FROM c LEFT JOIN longer ON longer.lang = c.lang AND longer.phrase = c.phrase, (SELECT unnest([1, 2, 3, 4]) AS i), f l, f r, total
  WHERE (held IS NULL OR 100 * held < 100 * c.a) AND i < c.words AND l.lang = c.lang AND r.lang = c.lang AND total.lang = c.lang AND l.phrase = array_to_string(w[1:i], ' ') AND r.phrase = array_to_string(w[i + 1:], ' ')
), lowest AS (
  SELECT lang, phrase, a, l, r, n, CAST(1000 * a::HUGEINT * n // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000 * a::HUGEINT * n // (l::HUGEINT * r), k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM lowest
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_hilbert_ann": op5_hilbert_ann,
    "op6_token_output": op6_token_output,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {"op4_warc_fixity": OP4_SQL, "op12_jaccard_join": OP12_SQL, "op13_phrases": OP13_SQL}
