"""Profiling and cleaning queries."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.operators import clean, profile, sample
from tallyforge.plans import corpus as C
from tallyforge.plans.base import query, table, with_blocks

_RULED = """
hs AS (SELECT md5, count(*) AS n, count(*) FILTER (NOT ok) AS n_unreadable, count(*) FILTER (ok AND is_copy) AS n_copy,
              min(class) <> max(class) AS crossed FROM m GROUP BY md5),
ruled AS (SELECT m.*, CASE WHEN NOT ok THEN 'unreadable' WHEN is_copy THEN 'copy' WHEN crossed THEN 'cross_class' ELSE 'pass' END AS r
          FROM m LEFT JOIN hs USING (md5)),
final AS (SELECT *, CASE WHEN r = 'pass' AND row_number() OVER (PARTITION BY md5, class, r ORDER BY key) > 1 THEN 'within_dup'
                         WHEN r = 'pass' THEN 'kept' ELSE r END AS rule FROM ruled)
"""


@query("manifest_docs", with_blocks("SELECT key, class, grp AS \"group\", md5, bytes::BIGINT AS bytes, ok, is_copy FROM m", C.MANIFEST))
def manifest_docs(spark, sf):
    return C.doc_manifest(spark, sf)


@query(
    "clean_index",
    with_blocks(
        """SELECT key, class, (SELECT count(DISTINCT s.source) FROM documents s WHERE s.source < class) AS label,
           grp AS "group", md5, bytes::BIGINT AS bytes FROM final WHERE rule = 'kept'""",
        C.MANIFEST, _RULED,
    ),
)
def clean_index(spark, sf):
    out = clean.clean_index(C.doc_manifest(spark, sf), C.sources(spark, sf))
    return out.withColumn("label", F.col("label").cast("bigint"))


@query(
    "clean_index_by_lang",
    with_blocks(
        "SELECT key, class, md5, bytes::BIGINT AS bytes FROM final WHERE rule = 'kept'",
        C.MANIFEST.replace("source AS class, lang", "lang AS class, lang"), _RULED,
    ),
)
def clean_index_by_lang(spark, sf):
    out = clean.clean_index(C.doc_manifest(spark, sf, "lang"), C.langs(spark, sf))
    return out.select("key", "class", "md5", "bytes")


@query(
    "cleaning_ledger",
    with_blocks(
        """SELECT r.rule, count(f.rule) AS n FROM (VALUES ('unreadable'), ('copy'), ('cross_class'), ('within_dup'), ('kept')) r(rule)
           LEFT JOIN final f USING (rule) GROUP BY 1""",
        C.MANIFEST, _RULED,
    ),
)
def cleaning_ledger(spark, sf):
    return clean.cleaning_ledger(C.doc_manifest(spark, sf), C.sources(spark, sf))


@query(
    "dup_groups",
    with_blocks(
        """SELECT md5, count(*) AS n, min(key) AS first_key, string_agg(DISTINCT class, ',' ORDER BY class) AS classes,
           count(DISTINCT class) > 1 AS cross_class FROM m GROUP BY md5 HAVING count(*) > 1""",
        C.MANIFEST,
    ),
)
def dup_groups(spark, sf):
    g = profile.dup_groups(C.doc_manifest(spark, sf))
    return g.withColumn("classes", F.array_join("classes", ","))


@query(
    "dup_members",
    with_blocks(
        "SELECT key, class, md5, n FROM (SELECT key, class, md5, count(*) OVER (PARTITION BY md5) AS n FROM m) WHERE n > 1",
        C.MANIFEST,
    ),
)
def dup_members(spark, sf):
    return profile.dup_members(C.doc_manifest(spark, sf))


@query(
    "dup_summary",
    with_blocks(
        """SELECT count(*) FILTER (n > 1) AS n_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS n_redundant,
           count(*) FILTER (n > 1 AND x) AS n_cross_class, count(*) AS n_unique, sum(c)::BIGINT AS n_copies
           FROM (SELECT md5, count(*) AS n, count(DISTINCT class) > 1 AS x, count(*) FILTER (is_copy) AS c FROM m GROUP BY md5)""",
        C.MANIFEST,
    ),
)
def dup_summary(spark, sf):
    return profile.dup_summary(C.doc_manifest(spark, sf))


@query(
    "class_stats",
    with_blocks(
        """SELECT lang AS class, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(DISTINCT md5) AS n_unique_md5,
             count(DISTINCT grp) AS n_groups, quantile_cont(n_chars, 0.5) AS med_w, quantile_cont(bytes, 0.5) AS med_h,
             min(n_chars) AS min_w, max(n_chars) AS max_w, min(bytes)::BIGINT AS min_h, max(bytes)::BIGINT AS max_h,
             round(avg(n_chars / bytes::DOUBLE), 6) AS mean_ink,
             round(quantile_cont(n_chars, 0.5) / quantile_cont(bytes, 0.5), 4) AS med_aspect,
             round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM m), 4) AS share_pct,
             round_even(0.8::DOUBLE * count(*), 0)::BIGINT AS n_train_80,
             (count(*) - round_even(0.8::DOUBLE * count(*), 0))::BIGINT AS n_val_20
           FROM m GROUP BY lang""",
        C.MANIFEST,
    ),
)
def class_stats(spark, sf):
    d = C.documents(spark, sf)
    m = clean.manifest(d, "doc_id", "lang", "source", "text", ok=F.col("n_chars") >= C.MIN_CHARS, extra=["n_chars"])
    m = m.withColumn("ink", F.col("n_chars") / F.col("bytes"))
    return profile.class_stats(m, C.langs(spark, sf), "n_chars", "bytes", "ink")


@query(
    "gini",
    """SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini
       FROM (SELECT n::DOUBLE AS x, row_number() OVER (ORDER BY n) AS i FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
)
def gini(spark, sf):
    counts = sample.class_counts(C.documents(spark, sf), C.langs(spark, sf), "lang")
    return profile.gini(counts).select(F.round("gini", 6).alias("gini"))


@query(
    "corpus_summary",
    with_blocks(
        """SELECT count(*) AS n_total, count(*) FILTER (ok) AS n_ok, count(DISTINCT grp) AS n_groups,
             quantile_cont(n_chars, 0.5) AS med_w, quantile_cont(bytes, 0.5) AS med_h,
             (SELECT count(*) FROM cs) AS n_classes,
             (SELECT round(max(n) / min(n)::DOUBLE, 2) FROM cs) AS imbalance,
             (SELECT round(100.0::DOUBLE * sum(n) FILTER (r <= 2) / sum(n), 2) FROM cs) AS top_share_pct,
             (SELECT count(*) FILTER (n < 150) FROM cs) AS n_classes_lt_150, (SELECT count(*) FILTER (n < 120) FROM cs) AS n_classes_lt_120,
             (SELECT string_agg(class || '=' || n, ';' ORDER BY class) FROM cs) AS per_class,
             (SELECT round(2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 4) FROM cs) AS gini,
             (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT left(grp, 4) AS k, count(*) AS n FROM m GROUP BY ALL) WHERE k IS NOT NULL) AS per_prefix,
             count(*) FILTER (grp IS NULL) AS n_no_prefix,
             (SELECT string_agg(k || '=' || n, ';' ORDER BY k) FROM (SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS k, count(*) AS n FROM m GROUP BY ALL)) AS per_category,
             0::BIGINT AS n_no_category,
             count(DISTINCT key // 10) AS n_docs,
             round(avg(n_chars / bytes::DOUBLE), 4) AS mid_grey
           FROM m""",
        C.MANIFEST,
        """cs AS (SELECT lang AS class, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS r,
                         row_number() OVER (ORDER BY count(*)) AS i FROM m GROUP BY lang)""",
    ),
)
def corpus_summary(spark, sf):
    d = C.documents(spark, sf)
    m = clean.manifest(d, "doc_id", "lang", "source", "text", ok=F.col("n_chars") >= C.MIN_CHARS, extra=["n_chars"])
    kind = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    d = profile.corpus_summary(
        m, C.langs(spark, sf), "n_chars", "bytes", thresholds=(150, 120), top=2,
        prefix=F.substring("group", 1, 4), category=kind, doc=F.floor(F.col("key") / 10), grey=F.col("n_chars") / F.col("bytes"),
    )
    # maps as text, in the order of their keys, so that any engine can compare them
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return d.withColumns({c: listed(c) for c in ("per_class", "per_prefix", "per_category")})


@query(
    "grouped_counts",
    """SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""",
)
def grouped_counts(spark, sf):
    return profile.grouped_counts(C.documents(spark, sf), ["lang", "source"])


@query("class_counts", "SELECT lang AS class, (dense_rank() OVER (ORDER BY lang) - 1)::BIGINT AS label, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, sf):
    out = sample.class_counts(C.documents(spark, sf), C.langs(spark, sf), "lang")
    return out.withColumn("label", F.col("label").cast("bigint"))


@query(
    "coverage_matrix",
    """WITH d AS (SELECT DISTINCT p_type AS class FROM part), cell AS (SELECT p_brand, p_type, max((p_size >= 45)::INT) AS ok FROM part GROUP BY ALL),
       g AS (SELECT b.p_brand AS entity, d.class, c.ok FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN d LEFT JOIN cell c ON c.p_brand = b.p_brand AND c.p_type = d.class)
       SELECT entity, coalesce(sum(ok), 0)::BIGINT AS n_ok, count(*) FILTER (ok = 0) AS n_blank, count(*) FILTER (ok IS NULL) AS n_missing,
              (count(*) - coalesce(sum(ok), 0))::BIGINT AS n_bad, count(*) - coalesce(sum(ok), 0) > 1 AS flagged FROM g GROUP BY entity""",
)
def coverage_matrix(spark, sf):
    part = table(spark, sf, "part")
    dim = Classes.from_column(part, "p_type")
    return profile.coverage_matrix(part, "p_brand", "p_type", F.col("p_size") >= 45, dim, max_missing=1)


@query(
    "class_support",
    """SELECT d.class, count(DISTINCT p.p_brand) AS n_entities FROM (SELECT DISTINCT p_type AS class FROM part) d
       LEFT JOIN part p ON p.p_type = d.class AND p.p_size >= 45 GROUP BY d.class""",
)
def class_support(spark, sf):
    part = table(spark, sf, "part")
    return profile.class_support(part, "p_brand", "p_type", F.col("p_size") >= 45, Classes.from_column(part, "p_type"))


_SRC = [f"src{i}" for i in range(20)]


@query(
    "source_coverage",
    """WITH t AS (SELECT lang, """
    + ", ".join(f"count(*) FILTER (source = '{s}') AS n_{s}" for s in _SRC)
    + """, count(*) AS total FROM documents GROUP BY lang)
       SELECT coalesce(d.class, t.lang) AS class, """
    + ", ".join(f"coalesce(n_{s}, 0)::BIGINT AS n_{s}" for s in _SRC)
    + """, coalesce(total, 0)::BIGINT AS total, CASE WHEN d.class IS NULL THEN 'unmapped' WHEN total IS NULL THEN 'no_samples' ELSE 'ok' END AS status
       FROM (VALUES ('en'), ('fr'), ('it'), ('de')) d(class) FULL JOIN t ON t.lang = d.class""",
)
def source_coverage(spark, sf):
    dim = Classes.of(spark, ["en", "fr", "it", "de"])
    return profile.source_coverage(C.documents(spark, sf), "lang", "source", dim, _SRC)


@query(
    "source_ranges",
    """SELECT source, count(*) AS n_classes, min(n) AS min_n, quantile_cont(n, 0.5) AS median_n, round(avg(n), 6) AS mean_n, max(n) AS max_n
       FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""",
)
def source_ranges(spark, sf):
    return profile.source_ranges(C.documents(spark, sf), "lang", "source", C.langs(spark, sf))


_EXTRA = ("src15", "src16", "src17", "src18", "src19")


@query(
    "compare_distributions",
    f"""WITH r AS (SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.5) AS med, round(avg(n_chars), 4) AS mean FROM documents WHERE source NOT IN {_EXTRA} GROUP BY lang),
        e AS (SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.5) AS med, round(avg(n_chars), 4) AS mean FROM documents WHERE source IN {_EXTRA} GROUP BY lang)
        SELECT r.lang AS class, r.n AS n_real, r.med AS med_real, r.mean AS mean_real, e.n AS n_other, e.med AS med_other, e.mean AS mean_other,
               round(e.med / r.med, 6) AS ratio, abs(e.med / r.med - 1) <= 0.35 AS within FROM r JOIN e USING (lang)""",
)
def compare_distributions(spark, sf):
    d = C.documents(spark, sf)
    extra = F.col("source").isin(*_EXTRA)
    return profile.compare_distributions(d.where(~extra), d.where(extra), "lang", "n_chars")


@query(
    "leakage_report",
    with_blocks(
        """SELECT lang AS kind, sum(v)::BIGINT AS n_val, coalesce(sum(v) FILTER (t > 0), 0)::BIGINT AS n_leaked,
                  round(coalesce(sum(v) FILTER (t > 0), 0)::DOUBLE / sum(v), 6) AS leak_share
           FROM (SELECT lang, source, count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'train') AS t FROM sp GROUP BY ALL) GROUP BY lang""",
        C.SPLIT,
    ),
)
def leakage_report(spark, sf):
    return profile.leakage_by_side(C.split_docs(spark, sf), "split", "lang", ["source"])


@query(
    "audit_overlap",
    with_blocks(
        """SELECT coalesce(sum(na), 0)::BIGINT AS n_a, coalesce(sum(nb), 0)::BIGINT AS n_b, coalesce(sum(nb) FILTER (h IS NOT NULL AND na > 0), 0)::BIGINT AS n_shared,
                  coalesce(sum(nb) FILTER (h IS NOT NULL AND na = 0), 0)::BIGINT AS n_new, coalesce(sum(other) FILTER (h IS NOT NULL AND na > 0), 0)::BIGINT AS n_moved,
                  coalesce(sum(na) FILTER (h IS NOT NULL AND nb = 0), 0)::BIGINT AS n_dropped,
                  coalesce(sum(na) FILTER (h IS NULL), 0)::BIGINT AS null_a, coalesce(sum(nb) FILTER (h IS NULL), 0)::BIGINT AS null_b
           FROM (SELECT h, sum(na) AS na, sum(nb) AS nb, coalesce(sum(nb) FILTER (na = 0), 0) AS other FROM (
                   SELECT h, lang, sum(a) AS na, sum(b) AS nb FROM (SELECT md5(text) AS h, lang, 1 AS a, 0 AS b FROM documents
                     UNION ALL SELECT md5(text), lang, 0, 1 FROM relabelled) GROUP BY ALL) GROUP BY h)""",
        C.RELABELLED,
    ),
)
def audit_overlap(spark, sf):
    a = C.documents(spark, sf).select(F.md5("text").alias("h"), "lang")
    b = C.relabelled(spark, sf).select(F.md5("text").alias("h"), "lang")
    return profile.audit_overlap(a, b, "h", "lang")


@query(
    "per_class_delta",
    with_blocks(
        """SELECT class, before, after, after - before AS delta FROM (
             SELECT coalesce(a.lang, b.lang) AS class, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after
             FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS n FROM relabelled GROUP BY 1) b ON a.lang = b.lang)
           WHERE before <> after""",
        C.RELABELLED,
    ),
)
def per_class_delta(spark, sf):
    return profile.per_class_delta(C.documents(spark, sf), C.relabelled(spark, sf), "lang")
