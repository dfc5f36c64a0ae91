"""Bindings of the test tables to corpus concepts, in Spark and as CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.functions.hashing import hash_hex
from tallyforge.operators.clean import manifest
from tallyforge.operators.split import stratified_split
from tallyforge.plans.base import table

MIN_CHARS = 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def langs(spark: SparkSession, sf: str) -> Classes:
    return Classes.from_column(documents(spark, sf), "lang")


def sources(spark: SparkSession, sf: str) -> Classes:
    return Classes.from_column(documents(spark, sf), "source")


def item_name(key: str = "doc_id"):
    """A file-like name; a few items carry a copy or variant prefix, chosen by hash."""
    mark = F.substring(hash_hex("name", key), 1, 2)
    prefix = F.when(mark < "04", "Copy of ").when(mark < "0c", "aug_").otherwise("")
    return F.concat(prefix, F.col("source"), F.lit("_"), F.col(key).cast("string"), F.lit(".txt"))


def doc_manifest(spark: SparkSession, sf: str, cls: str = "source") -> DataFrame:
    d = documents(spark, sf).withColumn("name", item_name())
    return manifest(
        d, "doc_id", cls, "source", "text",
        ok=F.col("n_chars") >= MIN_CHARS,
        is_copy=F.col("name").startswith("Copy of "),
    )


def split_docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents with ``split``."""
    return stratified_split(documents(spark, sf), "lang", "doc_id", seed=42, rows=langs(spark, sf).rows)


def relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """A second version of the corpus: some labels moved to the next language, some rows gone."""
    h = F.md5("text")
    nxt = F.create_map(*[F.lit(x) for x in ("en", "fr", "fr", "de", "de", "es", "es", "en")])
    d = documents(spark, sf).where(F.substring(h, 1, 2) != "ff")
    return d.withColumn("lang", F.when(F.substring(h, 1, 1) == "0", F.element_at(nxt, F.col("lang"))).otherwise(F.col("lang")))


NAMED = """
named AS (SELECT *, (CASE WHEN left(md5('name:' || doc_id), 2) < '04' THEN 'Copy of '
                          WHEN left(md5('name:' || doc_id), 2) < '0c' THEN 'aug_' ELSE '' END)
                    || source || '_' || doc_id || '.txt' AS name FROM documents)
"""
MANIFEST = (
    NAMED.strip()
    + """,
m AS (SELECT doc_id AS key, source AS class, lang, source AS grp, md5(text) AS md5,
             strlen(text) AS bytes, n_chars, (text IS NOT NULL AND strlen(text) > 0 AND n_chars >= 20) AS ok,
             name LIKE 'Copy of %' AS is_copy, name FROM named)
"""
)
SPLIT = """
sp AS MATERIALIZED (SELECT * EXCLUDE (rk, nc), CASE WHEN rk <= (CASE WHEN nc >= 5 THEN round_even(0.2::DOUBLE * nc, 0)
              WHEN nc >= 2 THEN 1 ELSE 0 END) THEN 'val' ELSE 'train' END AS split
       FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rk,
                    count(*) OVER (PARTITION BY lang) AS nc FROM documents))
"""
RELABELLED = """
relabelled AS (SELECT doc_id, text, CASE WHEN left(md5(text), 1) = '0' THEN
                 CASE lang WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' ELSE 'en' END ELSE lang END AS lang,
                 source, n_chars FROM documents WHERE left(md5(text), 2) <> 'ff')
"""
FOLDS = """
fd AS MATERIALIZED (SELECT * EXCLUDE (r, q, m), CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS fold
       FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r,
                    count(*) OVER (PARTITION BY lang) // 5 AS q, count(*) OVER (PARTITION BY lang) % 5 AS m FROM documents))
"""
