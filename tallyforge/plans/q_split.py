"""Split, fold, sampling and weighting queries."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.operators import sample, split
from tallyforge.plans import corpus as C
from tallyforge.plans.base import query, table, with_blocks

_RANKED = """
rk AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r,
              count(*) OVER (PARTITION BY lang) AS n FROM documents)
"""
_HELD = """
gs AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
tries AS (SELECT d.draw, source, n, row_number() OVER (PARTITION BY d.draw ORDER BY md5('42:' || d.draw || ':' || source), source) AS r
          FROM gs CROSS JOIN range(200) d(draw)),
per AS (SELECT draw, sum(n) AS held FROM tries WHERE r <= 4 GROUP BY draw),
best AS (SELECT draw, held FROM per ORDER BY abs(held::DOUBLE / (SELECT sum(n) FROM gs) - 0.2), draw LIMIT 1),
held AS (SELECT source FROM tries JOIN best USING (draw) WHERE r <= 4)
"""
_EV_SPLIT = """
es AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
er AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY md5('42:' || user_id), user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(n) OVER (PARTITION BY event_type) AS total FROM es),
eh AS (SELECT event_type, user_id, n, before < 0.15::DOUBLE * total AS held FROM er)
"""


@query("stratified_split", with_blocks("SELECT doc_id, lang, split FROM sp", C.SPLIT))
def stratified_split(spark, sf):
    return C.split_docs(spark, sf).select("doc_id", "lang", "split")


@query(
    "group_holdout_split",
    with_blocks("SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM held) THEN 'val' ELSE 'train' END AS doc_split FROM documents", _HELD),
)
def group_holdout_split(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "source")
    return split.group_holdout_split(d, "source")


@query(
    "group_fraction_holdout",
    with_blocks("SELECT event_type, user_id, n, held FROM eh", _EV_SPLIT),
)
def group_fraction_holdout(spark, sf):
    return split.group_fraction_holdout(table(spark, sf, "events"), "event_type", "user_id")


@query(
    "group_fraction_holdout_docs",
    """SELECT lang, source, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY md5('7:' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              < 0.3::DOUBLE * sum(n) OVER (PARTITION BY lang) AS held FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)""",
)
def group_fraction_holdout_docs(spark, sf):
    return split.group_fraction_holdout(C.documents(spark, sf), "lang", "source", frac=0.3, seed=7)


@query(
    "holdout_checks",
    with_blocks(
        """SELECT event_type AS class, count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_probe,
             CASE WHEN count(*) FILTER (held) > 0 AND count(*) FILTER (NOT held) = 0 THEN 'probe_only' WHEN count(*) FILTER (held) = 0 THEN 'absent'
                  WHEN count(*) FILTER (held) < 280 THEN 'thin' ELSE 'ok' END AS status, 0::BIGINT AS leaked_groups
           FROM events e JOIN hu USING (user_id) GROUP BY event_type""",
        """us AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
           hu AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY md5('42:' || user_id), user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                         < 0.15::DOUBLE * sum(n) OVER () AS held FROM us)""",
    ),
)
def holdout_checks(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "user_id")
    # a user with very many events is a row per event type before the join
    users = split.group_fraction_holdout(ev, None, "user_id").select("user_id", "held")
    per = ev.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    classes = split.Classes.from_column(ev, "event_type")
    return split.holdout_checks(per.join(users, "user_id"), "held", "user_id", "event_type", classes, thin=280, weight="n")


@query("kfold", with_blocks("SELECT doc_id, lang, (r - 1) % 5 AS fold FROM rk", _RANKED))
def kfold(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    return split.kfold(d, "lang", "doc_id").withColumn("fold", F.col("fold").cast("bigint"))


@query("range_folds", with_blocks("SELECT doc_id, lang, fold FROM fd", C.FOLDS))
def range_folds(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    return split.range_folds(d, "lang", "doc_id", rows=C.langs(spark, sf).rows).withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "kfold_table",
    with_blocks(
        "SELECT lang AS class, count(*) AS n, "
        + ", ".join(f"count(*) FILTER ((r - 1) % 5 = {f}) AS fold{f}" for f in range(5))
        + ", count(*) < 5 AS too_small FROM rk GROUP BY lang",
        _RANKED,
    ),
)
def kfold_table(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    return split.kfold_table(split.kfold(d, "lang", "doc_id"), "lang")


@query(
    "split_overlap_check",
    with_blocks(
        """SELECT k AS split_kind, (SELECT count(*) FROM sp a JOIN sp b USING (doc_id) WHERE a.split = 'train' AND b.split = 'val') AS n_both,
             CASE k WHEN 'split' THEN (SELECT count(*) FROM sp WHERE split = 'train') ELSE (SELECT count(*) FROM documents WHERE source NOT IN (SELECT source FROM held)) END AS n_train,
             CASE k WHEN 'split' THEN (SELECT count(*) FROM sp WHERE split = 'val') ELSE (SELECT count(*) FROM documents WHERE source IN (SELECT source FROM held)) END AS n_val
           FROM (VALUES ('split'), ('doc_split')) t(k)""",
        C.SPLIT, _HELD,
    ),
)
def split_overlap_check(spark, sf):
    return split.split_overlap_check(_both(spark, sf), "doc_id", ["split", "doc_split"])


def _both(spark, sf):
    d = split.stratified_split(C.documents(spark, sf).select("doc_id", "lang", "source"), "lang", "doc_id", rows=C.langs(spark, sf).rows)
    return split.group_holdout_split(d, "source")


@query(
    "split_table",
    with_blocks(
        """SELECT lang AS class, count(*) AS n_clean, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
             count(*) FILTER (source NOT IN (SELECT source FROM held)) AS n_doc_train, count(*) FILTER (source IN (SELECT source FROM held)) AS n_doc_val,
             count(*) FILTER (split = 'val') = 0 AS zero_val FROM sp GROUP BY lang""",
        C.SPLIT, _HELD,
    ),
)
def split_table(spark, sf):
    return split.split_table(_both(spark, sf), C.langs(spark, sf), "lang")


@query("subset_per_class", with_blocks("SELECT doc_id, lang FROM rk WHERE r <= greatest(1, round_even(0.1::DOUBLE * n, 0))", _RANKED))
def subset_per_class(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    return sample.subset_per_class(d, "lang", "doc_id", 0.1, rows=C.langs(spark, sf).rows)


@query("sample_n_per_class", with_blocks("SELECT doc_id, lang FROM rk WHERE r <= 30", _RANKED))
def sample_n_per_class(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    return sample.sample_n_per_class(d, "lang", "doc_id", 30, rows=C.langs(spark, sf).rows)


_POOL = ("src15", "src16", "src17", "src18", "src19")


def _pools(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang", "source")
    extra = F.col("source").isin(*_POOL)
    return d.where(~extra), d.where(extra)


_FILL = f"""
rc AS (SELECT lang, count(*) AS n FROM documents WHERE source NOT IN {_POOL} GROUP BY lang),
ex AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('43:' || doc_id), doc_id) AS r FROM documents WHERE source IN {_POOL})
"""


@query(
    "fill_extra",
    with_blocks(
        """SELECT doc_id, lang, source FROM ex JOIN rc USING (lang)
           WHERE r <= least(CASE WHEN rc.n > 400 THEN 0 ELSE greatest(0, 120 - rc.n) END, 25)""",
        _FILL,
    ),
)
def fill_extra(spark, sf):
    real, extra = _pools(spark, sf)
    dim = C.langs(spark, sf)
    counts = sample.class_counts(real, dim, "lang")
    out = sample.fill_extra(extra, counts, "lang", "doc_id", "fill", fill_to=120, max_real=400, max_per_class=25, seed=43, rows=dim.rows)
    return out.select("doc_id", "lang", "source")


@query("fill_extra_all", with_blocks("SELECT doc_id, lang, source FROM ex WHERE r <= 40", _FILL))
def fill_extra_all(spark, sf):
    real, extra = _pools(spark, sf)
    dim = C.langs(spark, sf)
    counts = sample.class_counts(real, dim, "lang")
    out = sample.fill_extra(extra, counts, "lang", "doc_id", "all", max_per_class=40, seed=43, rows=dim.rows)
    return out.select("doc_id", "lang", "source")


@query(
    "balance_sources",
    f"""SELECT lang AS class, count(*) FILTER (source NOT IN {_POOL}) AS n_real, count(*) FILTER (source IN {_POOL}) AS n_extra, count(*) AS n_total FROM documents GROUP BY lang""",
)
def balance_sources(spark, sf):
    real, extra = _pools(spark, sf)
    return sample.balance_sources(real, extra, C.langs(spark, sf), "lang")


_COUNTS = "cc AS (SELECT lang AS class, count(*) AS n FROM documents GROUP BY lang)"


@query(
    "sample_weights",
    with_blocks(
        """SELECT doc_id, lang, round(least(pow(n, -1.0::DOUBLE) / (SELECT sum(pow(n, -1.0::DOUBLE) * n) / sum(n) FROM cc), 1.5::DOUBLE), 6) AS weight
           FROM documents JOIN cc ON cc.class = lang""",
        _COUNTS,
    ),
)
def sample_weights(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    out = sample.sample_weights(d, C.langs(spark, sf), "lang", 1.0, cap=1.5)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "range_draw",
    with_blocks(
        """SELECT draw, class FROM (SELECT doc_id AS draw, ('0x' || substr(md5('42:draw:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u1 FROM documents) d
           JOIN cdf ON u1 >= lo AND u1 < hi""",
        _COUNTS,
        """wt AS (SELECT class, n, n * least(pow(n, -0.5::DOUBLE) / (SELECT sum(pow(n, -0.5::DOUBLE) * n) / sum(n) FROM cc), 10.0::DOUBLE) AS mass FROM cc),
           hi AS (SELECT class, n, sum(mass) OVER (ORDER BY class) / sum(mass) OVER () AS hi FROM wt),
           cdf AS (SELECT class, n, hi, coalesce(lag(hi) OVER (ORDER BY class), 0) AS lo FROM hi)""",
    ),
)
def range_draw(spark, sf):
    dim = C.langs(spark, sf)
    d = C.documents(spark, sf)
    cdf = sample.class_cdf(sample.weight_table(sample.class_counts(d, dim, "lang"), 0.5))
    h = sample.hash_hex(42, F.lit("draw"), F.col("doc_id"))
    draws = d.select(F.col("doc_id").alias("draw"), sample.uniform(h).alias("u1"))
    return sample.range_draw(draws, "u1", cdf).select("draw", "class")


@query(
    "weighted_resample",
    with_blocks(
        """SELECT draw, rk.lang, rk.doc_id FROM (
             SELECT draw, class, floor(u2 * n)::BIGINT + 1 AS pos FROM (
               SELECT draw, ('0x' || substr(md5('42:draw:' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u1,
                            ('0x' || substr(md5('42:draw:' || draw), 9, 8))::BIGINT / 4294967296.0::DOUBLE AS u2
               FROM range((SELECT count(*) FROM documents)) t(draw)) d JOIN cdf ON u1 >= lo AND u1 < hi) c
           JOIN rk ON rk.lang = c.class AND rk.r = c.pos""",
        _COUNTS, _RANKED,
        """wt AS (SELECT class, n, n * least(pow(n, -0.5::DOUBLE) / (SELECT sum(pow(n, -0.5::DOUBLE) * n) / sum(n) FROM cc), 10.0::DOUBLE) AS mass FROM cc),
           hi AS (SELECT class, n, sum(mass) OVER (ORDER BY class) / sum(mass) OVER () AS hi FROM wt),
           cdf AS (SELECT class, n, hi, coalesce(lag(hi) OVER (ORDER BY class), 0) AS lo FROM hi)""",
    ),
)
def weighted_resample(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang")
    # as many draws as rows, like one epoch
    return sample.weighted_resample(d, C.langs(spark, sf), "lang", "doc_id", None, 0.5)


@query("class_weights", with_blocks("SELECT class, n, round(pow(n, -0.5::DOUBLE) / (SELECT avg(pow(n, -0.5::DOUBLE)) FROM cc), 6) AS weight FROM cc", _COUNTS))
def class_weights(spark, sf):
    counts = sample.class_counts(C.documents(spark, sf), C.langs(spark, sf), "lang")
    return sample.class_weights(counts, 0.5).select("class", "n", F.round("weight", 6).alias("weight"))


@query(
    "cb_weights",
    with_blocks(
        "SELECT class, n, round(w / (SELECT avg(w) FROM b), 6) AS weight FROM b",
        _COUNTS, "b AS (SELECT class, n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS w FROM cc)",
    ),
)
def cb_weights(spark, sf):
    counts = sample.class_counts(C.documents(spark, sf), C.langs(spark, sf), "lang")
    return sample.cb_weights(counts).select("class", "n", F.round("weight", 6).alias("weight"))


@query("log_prior", with_blocks("SELECT class, n, round(ln(greatest(n, 1)::DOUBLE / (SELECT sum(n) FROM cc)), 6) AS log_prior FROM cc", _COUNTS))
def log_prior(spark, sf):
    counts = sample.class_counts(C.documents(spark, sf), C.langs(spark, sf), "lang")
    return sample.log_prior(counts).select("class", "n", F.round("log_prior", 6).alias("log_prior"))
