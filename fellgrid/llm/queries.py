"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embedding, langid, minhash, mixing, secrets, suffix_dedup, suffix_tree, token_counts, urls

#: The rules that the url query applies (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), size=3, percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS rules(host, path, verdict)")
    return urls.judge_urls(_read(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.filter(fold != 1))
    found = langid.identify(docs.select("doc_id", "text", (fold == 1).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = suffix_tree.score_texts(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filters": op5_url_filters,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_lm_scores": op9_lm_scores,
    "op10_token_counts": op10_token_counts,
}

ORACLE: dict[str, str] = {
    "op5_url_filters": r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, rv)),
m AS (
  SELECT h.page_id, h.host, h.path, r.rh || r.rp AS rule, r.rv,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rh || r.rp) DESC) AS k
  FROM h LEFT JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op8_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS size,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS ord, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS DOUBLE) AS weight,
        source_size * CAST(2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS pool FROM s),
o AS (SELECT *,
        pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS money,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS claims FROM w),
c AS (SELECT *, cap * claims <= money * weight AS capped FROM o),
t AS (SELECT source, source_size, n,
        CASE WHEN capped THEN cap ELSE (pool - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM c),
u AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST(floor(CAST(CAST('0x' || substr(ord, 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) * ceil(n / CAST(100000 AS DOUBLE))) AS BIGINT) AS part
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY size, ord, tie) AS k,
        CAST(CAST('0x' || substr(md5('mix:start:' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(source, '') || ':' || CAST(part AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS start
      FROM u)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + floor(start + k * (rate - floor(rate))) - floor(start + (k - 1) * (rate - floor(rate)))) AS BIGINT) AS taken FROM r
""",
}
