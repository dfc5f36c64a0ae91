"""Quality rules with a verdict on the host: rule failures by host, shrunk with an empirical beta prior.

Every text is measured row-locally with SQL functions; the measures, without the text, are
written once and counted per host with map-side combine. For each rule, the failure rates of all
hosts give a beta prior (method of moments), every host's rate is shrunk towards it, and a host
is bad if a shrunk rate is above the limit: a host with two rows of which two fail is judged
mostly by the prior, one with thousands by its own rows. The verdicts are joined back to the rows;
a host with a third of all rows is split by the adaptive skew join.

Defined results: a NULL text counts as empty (no words, so it fails the base rules); rows with a
NULL host form a host of their own; equal lines and windows (ties) count by place; a very long text is one row like
any other; repeated rows count as often as they occur; an empty table
gives an empty result. Only the id, host and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import attach_row, settle
from tallyforge.functions.vectors import let
from tallyforge.llm.common import SPACE, word_array

GRAM = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_PERCENT = 30
# A host is bad if a shrunk failure rate is above this.
HOST_LIMIT = 0.5
# Bound of the prior's weight, in rows.
MOST_WEIGHT = 10_000.0


def _count(a: Column) -> Column:
    return F.size(a)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    worded = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return let(worded, lambda x: _count(x) - _count(F.array_distinct(x)))


def repeated_words(words: Column, size: int = GRAM) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the array.

    Windows are first compared by hash; only if two hashes agree, which is so in every text with a
    repeat, the windows are compared as text.
    """
    one = F.lit(1)

    def places(w: Column) -> Column:
        return F.sequence(F.lit(0), _count(w) - size)

    def distinct_hashes(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        grams = let(hashed, lambda h: F.transform(places(w), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))
        return let(grams, lambda g: _count(g) == _count(F.array_distinct(g)))

    def covered(w: Column) -> Column:
        text = F.transform(places(w), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]).alias("g"), i.alias("p")))

        def twice(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["g"] == F.get(s, j)["g"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), _count(s) - 1), lambda i: same(i, i - 1) | same(i, i + one))
            return F.array_sort(F.transform(hit, lambda i: F.get(s, i)["p"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(p, a["end"])).alias("n"))
        return let(F.array_sort(text), lambda s: F.aggregate(twice(s), start, step, lambda a: a["n"]))

    return let(words, lambda w: F.when(_count(w) < size, 0).when(distinct_hashes(w), 0).otherwise(covered(w)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = word_array(F.col(text_col))
    both = let(words, lambda w: F.struct(_count(w).alias("n"), repeated_words(w).alias("repeat")))
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        both.alias("w"),
        F.length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        duplicate_lines(text).cast("bigint").alias("n_dup_lines"),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("bigint").alias("n_lines"),
    )
    return d.select("*", F.col("w.n").cast("bigint").alias("n_words"), F.col("w.repeat").cast("bigint").alias("n_repeat_words")).drop("w")


def rules() -> dict[str, Column]:
    """Rules that a host answers for, over the columns of ``measures``."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def base_failed() -> Column:
    r = rules()
    return r["short"] | r["repetitive"]


def host_verdicts(measured: DataFrame, tests: dict[str, Column] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, <rule>_rate for each rule, host_ok): shrunk failure rates and the verdict.

    With m the overall rate, N rows and K hosts, the size-weighted variance of the hosts' rates is
    expected to be m (1 - m) (K/N + (1 - K/N) r) under a beta prior of weight 1/r - 1; r is solved
    from it. Where the rates vary no more than by chance, the prior has its largest weight.
    """
    tests = rules() if tests is None else tests
    names = list(tests)
    counts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(t.cast("bigint")).alias(k) for k, t in tests.items()])
    counts = settle(counts, "host-counts")
    n = F.col("n")
    prior = [F.count("*").alias("_hosts"), F.sum("n").alias("_rows")]
    for k in names:
        prior += [F.sum(k).alias(f"_f_{k}"), F.sum(F.col(k).cast("double") * F.col(k) / n).alias(f"_s_{k}")]
    known = attach_row(counts, counts.agg(*prior))
    chance = F.col("_hosts") / F.col("_rows")
    rates = []
    for k in names:
        m = F.col(f"_f_{k}") / F.col("_rows")
        spread = F.col(f"_s_{k}") / F.col("_rows") - m * m
        r = F.when((m > 0) & (m < 1) & (chance < 1), (spread / (m * (1 - m)) - chance) / (1 - chance)).otherwise(0.0)
        weight = F.least(F.lit(MOST_WEIGHT), 1 / F.greatest(r, F.lit(1e-9)) - 1)
        rates.append(((F.col(k) + m * weight) / (n + weight)).alias(f"{k}_rate"))
    shrunk = known.select("host", "n", *rates)
    ok = F.greatest(F.lit(0.0), *[F.col(f"{k}_rate") for k in names]) <= limit
    return shrunk.withColumn("host_ok", ok)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every row with base_failed, host_ok and kept."""
    measured = settle(measures(docs, id_col, text_col, host_col), "measures")
    verdicts = host_verdicts(measured, limit=limit).select(F.col("host").alias("_host"), "host_ok")
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["_host"])).drop("_host")
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("host_ok"))


JUDGE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
  FROM d WHERE len(ws) >= 8
), hit AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM hit) GROUP BY r
), m AS (
  SELECT doc_id, source, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    len(string_split(t, chr(10))) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive,
    10 * n_symbols > word_chars AS symbols, 2 * n_dup_lines > n_lines AS lines
  FROM m
), long AS (
  SELECT source, 'short' AS rule, short AS failed FROM f UNION ALL SELECT source, 'repetitive', repetitive FROM f
  UNION ALL SELECT source, 'symbols', symbols FROM f UNION ALL SELECT source, 'lines', lines FROM f
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS k FROM long GROUP BY ALL
), p AS (
  SELECT rule, count(*) / sum(n) AS chance, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS s FROM h GROUP BY rule
), q AS (
  SELECT rule, m, least(10000.0, 1 / greatest(CASE WHEN m > 0 AND m < 1 AND chance < 1
    THEN ((s - m * m) / (m * (1 - m)) - chance) / (1 - chance) ELSE 0 END, 1e-9) - 1) AS weight FROM p
), bad AS (
  SELECT source FROM h JOIN q USING (rule) GROUP BY source HAVING max((k + m * weight) / (n + weight)) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
