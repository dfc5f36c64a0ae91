"""The training-data pipeline: documents in, sharded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder
and rereads it as the next stage's docs, so a lost executor never costs more than one stage. All stages
but the last return the columns of ``documents``; the last adds size, shard and slot.

Texts without a recognised language go, then all but one of each group of similar texts (five-word
shingles, similarity 0.8 or more), then texts that hold a benchmark item. What is left is mixed to
the target weights, rows of small sources coming up to twice, and range-partitioned to 16 shards.

Defined results: a NULL or empty text has no letter and goes in the first stage; a NULL id or language is a row like
any other; of fully repeated rows one stays (they are one group of similar texts); columns of any name
pass through, but the last stage's replace carried ones of the same name; very long texts are read whole by
every stage; ties are settled by the smallest id, then the hash of the text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle, settled_tables
from tallyforge.llm import decontaminate, langid, mixing, sharding, similar
from tallyforge.llm.queries import mix_options, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    return langid.known_language(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, **mix_options())


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_records(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

# No stage but the mix can be said in SQL; tests/llm/test_pipeline.py has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # a stage's own tables go as soon as its result is written
        with settled_tables(spark):
            docs = settle(stage(spark, docs, sf_dir), name, owned=False)
    return docs
