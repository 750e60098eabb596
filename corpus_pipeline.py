"""A training corpus from the documents table: five stages, each one operator of ``fellgrid.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds
``copy``.  Stages read all that the stage before kept.  Null and empty texts leave at the first stage, as
they have no language; an empty table gives an empty result; extra columns travel along.  A null or repeated
doc_id makes no difference to what a stage sees of a row: rows stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgrid.llm import decontam, langid, minhash, mixing, secrets
from fellgrid.llm.common import cut, unused

#: Share of a text's words that its language must have; texts without such a language are of none, or of several.
LEAST_LANGUAGE_SCORE = 0.5

_ROW = "_fellgrid_row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that have a language: some letters, and one language for most of the words.  Where ``lang`` is null it becomes that language."""
    body = docs.columns
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in body)).alias("row"), F.col("text").alias("words"))
    found = langid.identify(marked, langid.fit(docs), text="words")
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    if "lang" not in body:
        return kept.select("row.*")
    return kept.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in body))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest doc_id (none comes last), then the smallest hash of the text.

    Different texts with the same doc_id both stay.
    """
    row = unused(docs.columns, _ROW)
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows.select(row, "text"), key=row).select(row, "component_id")
    order = F.struct("none", "doc_id", "h", row)
    known = rows.select(row, "doc_id", F.col("doc_id").isNull().alias("none"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    kept = groups.join(known, row).groupBy("component_id").agg(F.min(order).alias("least")).select(F.col(f"least.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, as it is or re-parameterised; rows are known by a 64-bit hash of the text."""
    row = unused(docs.columns, _ROW)
    rows = docs.withColumn(row, F.xxhash64(F.col("text").cast("string")))
    leaks = decontam.find_leaks(rows.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row)
    return rows.join(leaks.select(row).distinct(), row, "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with each secret replaced by a mark; n_chars follows the text."""
    clean = secrets.scan_secrets(docs, secrets.fit(docs), redact="<SECRET>")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; ``copy`` counts from 1 (a column of that name is replaced)."""
    mixed = mixing.mix_sources(docs).filter("copies > 0")
    return mixed.select(*(c for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("mix", mix)]

#: The stages with trained models and graph components are beyond SQL; tests/llm/test_pipeline.py compares run() with a brute-force version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
