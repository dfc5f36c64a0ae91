"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import brown, centroids, common, decontaminate, hostrules, htmlmain, langid, mixing, neardup, phrases, pii, runs, sharding, tokens

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_dup_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", neardup.fingerprint_hex(groups.fp).alias("fingerprint"), "component_id")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.id_part(F.col("doc_id"), 5) == 0
    net = langid.train(docs.where(~held_out), F.col("doc_id"), F.col("text"), F.col("lang"))
    done = langid.identify(docs.select("doc_id", "text"), net, keep=["doc_id"], score="score")
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_brown_class_scores")
def op9_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.id_part(F.col("doc_id"), 10) == 0
    model, done = brown.fit_and_score(docs, ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op10_repeated_phrases")
def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


@query("op5_host_rules", hostrules.JUDGE_SQL)
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


@query("op1_benchmark_decontamination")
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.similarity", "x.start_word", "x.n_words")


def mix_options() -> dict:
    """The tree of the mix (a domain by the number of the source, then language and source), its weights and its budget."""
    crawl = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).isin([str(i) for i in range(10)])
    return {
        "levels": {"domain": F.when(crawl, "crawl").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")},
        "weights": {
            "domain": F.when(F.col("domain") == "crawl", 0.6).otherwise(0.4),
            "lang": F.when(F.col("lang") == "en", 0.5).when(F.col("lang").isin("de", "fr"), 0.2).otherwise(0.1),
            "source": F.lit(1.0),
        },
        "budget": F.floor(F.col("total") * 0.8),
        "max_epochs": 2,
        "seed": 42,
    }


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    CASE WHEN regexp_matches(coalesce(source, ''), '(^|[^0-9])[0-9]$') THEN 'crawl' ELSE 'curated' END AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (2 * sum(tokens))::BIGINT AS supply FROM d GROUP BY ALL),
dom0 AS (
  SELECT domain, sum(supply) AS supply, CASE WHEN domain = 'crawl' THEN 0.6 ELSE 0.4 END::DOUBLE AS weight,
    (SELECT least(floor(sum(tokens) * 0.8::DOUBLE), sum(supply)) FROM leaf) AS budget FROM leaf GROUP BY domain
), dom AS (SELECT domain, budget_of AS budget FROM (%DOM%)),
lang0 AS (
  SELECT domain, lang, sum(supply) AS supply, CASE WHEN lang = 'en' THEN 0.5 WHEN lang IN ('de', 'fr') THEN 0.2 ELSE 0.1 END::DOUBLE AS weight, budget
  FROM leaf JOIN dom USING (domain) GROUP BY domain, lang, budget
), lan AS (SELECT domain, lang, budget_of AS budget FROM (%LANG%)),
src0 AS (
  SELECT l.domain, l.lang, l.source, l.supply, 1.0::DOUBLE AS weight, lan.budget
  FROM leaf l JOIN lan ON l.domain = lan.domain AND l.lang IS NOT DISTINCT FROM lan.lang
), src AS (SELECT domain, lang, source, budget_of AS budget FROM (%SRC%)),
plan AS (
  SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN floor(budget / tokens) ELSE 0 END::INTEGER AS full_epochs,
    budget - CASE WHEN tokens > 0 THEN floor(budget / tokens) ELSE 0 END * tokens AS rest
  FROM leaf l JOIN src s ON l.domain = s.domain AND l.lang IS NOT DISTINCT FROM s.lang AND l.source IS NOT DISTINCT FROM s.source
), run AS (
  SELECT d.*, full_epochs, rest, coalesce(sum(tokens) OVER (PARTITION BY d.domain, d.lang, d.source
    ORDER BY md5('42:' || full_epochs || ':' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, domain, lang, source, tokens, (full_epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS epochs FROM run
"""


def _fill_sql(nodes: str, parent: str) -> str:
    """Water filling of one level as windows: a child is filled if its supply / weight is below the level at its place."""
    part = f"PARTITION BY {parent}" if parent else ""
    upto = f"OVER ({part} ORDER BY supply / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)"
    return f"""
    SELECT *, CASE WHEN level IS NULL THEN supply ELSE least(supply, floor(round(weight * level, 6))) END AS budget_of FROM (
      SELECT *, arg_min(here, supply / weight) FILTER (WHERE supply / weight > here) OVER ({part}) AS level FROM (
        SELECT *, (budget - coalesce(sum(supply) {upto}, 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) {upto}, 0)) AS here FROM {nodes}))"""


for _mark, _nodes, _parent in (("%DOM%", "dom0", ""), ("%LANG%", "lang0", "domain"), ("%SRC%", "src0", "domain, lang")):
    MIX_SQL = MIX_SQL.replace(_mark, _fill_sql(_nodes, _parent))


@query("op6_source_mixing", MIX_SQL)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"], **mix_options())
    return mixed.select("doc_id", "domain", "lang", "source", "tokens", "epochs")


@query("op8_sampled_splitter_shards")
def op8_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key="tallyforge-surrogates-1")


@query("op11_centroid_clusters", centroids.CLUSTER_SQL)
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = runs.mark_runs(docs, runs.with_planted_runs(F.col("doc_id"), F.col("text")), keep=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = marked.select("*", runs.longest(F.col("runs")).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: The vocabulary whose tokens op13 counts.
TOKENIZER = "byte_bpe_50k.json"


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), F.col("text"), public_tokenizers.path(TOKENIZER), keep=["doc_id"])
