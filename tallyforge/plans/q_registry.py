"""Registry, source and sink queries. Runs are the scorer's models x prior strengths x split kinds."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, scratch_path, settle, small
from tallyforge.operators import metrics, profile, registry, score, split
from tallyforge.operators.codec import join_class_dim
from tallyforge.plans import corpus as C
from tallyforge.plans import scoring as S
from tallyforge.plans.base import query, table, with_blocks
from tallyforge.plans.q_metrics import _TAUS, TAU, big, log_priors, r6
from tallyforge.sources import files, sinks
from tallyforge.streaming import incoming

_MODELS = ("finals", "lengths", "vowels")


def experiments(spark, sf):
    """exp_id, model, tau, split_kind, n, top1, balanced_acc, macro_f1, minority_acc."""

    def make():
        held = split.group_holdout_groups(C.documents(spark, sf).select("source"), "source").select(F.col("grp").alias("source"), F.lit(True).alias("held"))
        adj = score.logit_adjust(S.scores(spark, sf), log_priors(spark, sf), _TAUS)
        p = score.predict(adj).join(small(held, 4), "source", "left")
        kinds = F.explode(F.when(F.col("held"), F.array(F.lit("strat"), F.lit("doc"))).otherwise(F.array(F.lit("strat")))).alias("split_kind")
        p = p.select("model", "tau", "y", "pred", "rank_true", kinds)
        m = metrics.metrics_of(p, ["model", "tau", "split_kind"], S.train_counts(spark, sf), S.dim(spark, sf).rows, S.MINORITY)
        exp = F.concat("model", F.lit("_t"), (F.col("tau") * 100).cast("int"), F.when(F.col("split_kind") == "doc", "_doc").otherwise("_T4"))
        return settle(m.select(exp.alias("exp_id"), "model", "tau", "split_kind", "n", "top1", "balanced_acc", "macro_f1", "minority_acc"), "experiments")

    return S._once(spark, sf, "experiments", make)


EXP = TAU + ",\n" + ",\n".join((
    "td AS (SELECT pt_.*, d.source FROM pt_ JOIN documents d ON d.doc_id = pt_.item_id)",
    """gs AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
       tries AS (SELECT d.draw, source, n, row_number() OVER (PARTITION BY d.draw ORDER BY md5('42:' || d.draw || ':' || source), source) AS r FROM gs CROSS JOIN range(200) d(draw)),
       bestd AS (SELECT draw FROM (SELECT draw, sum(n) AS held FROM tries WHERE r <= 4 GROUP BY draw) ORDER BY abs(held::DOUBLE / (SELECT sum(n) FROM gs) - 0.2), draw LIMIT 1),
       heldg AS (SELECT source FROM tries JOIN bestd USING (draw) WHERE r <= 4)""",
    "tk AS (SELECT *, 'strat' AS split_kind FROM td UNION ALL SELECT *, 'doc' FROM td WHERE source IN (SELECT source FROM heldg))",
    "ex AS MATERIALIZED (SELECT model || '_t' || (tau * 100)::INT || CASE split_kind WHEN 'doc' THEN '_doc' ELSE '_T4' END AS exp_id, * FROM (" + S.metrics_sql("tk", "model, tau, split_kind", S.MINORITY) + "))",
))


@query(
    "leaderboard",
    with_blocks(
        """SELECT exp_id, CASE WHEN tau = 0 THEN model || ' plain' ELSE model || ' adjusted' END AS short, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc,
                  row_number() OVER (ORDER BY round(balanced_acc, 9) DESC, exp_id) AS rank FROM ex WHERE split_kind = 'strat' AND exp_id LIKE '%\\_t%' ESCAPE '\\'""",
        EXP,
    ),
)
def leaderboard(spark, sf):
    e = experiments(spark, sf).withColumn("balanced_acc", F.round("balanced_acc", 9))
    short = F.when(F.col("tau") == 0, F.concat("model", F.lit(" plain"))).otherwise(F.concat("model", F.lit(" adjusted")))
    d = registry.leaderboard(e, contains="_t", split_kind="strat", short=short)
    return d.select("exp_id", "short", *r6("top1", "balanced_acc"), *big("rank"))


@query(
    "pair_split_gap",
    with_blocks(
        """SELECT regexp_replace(a.exp_id, '_doc$', '') AS base, round(a.top1, 6) AS top1_doc, round(b.top1, 6) AS top1_strat, round(100 * (a.top1 - b.top1), 4) AS top1_gap,
             round(100 * (a.balanced_acc - b.balanced_acc), 4) AS balanced_acc_gap FROM ex a JOIN ex b ON a.model = b.model AND a.tau = b.tau WHERE a.split_kind = 'doc' AND b.split_kind = 'strat'""",
        EXP,
    ),
)
def pair_split_gap(spark, sf):
    d = registry.pair_split_gap(experiments(spark, sf))
    return d.select("base", *r6("top1_doc", "top1_strat"), F.round("top1_gap", 4).alias("top1_gap"), F.round("balanced_acc_gap", 4).alias("balanced_acc_gap"))


@query(
    "grid_runs",
    with_blocks(
        """SELECT r.model, round(t0, 6) AS "t0", round(t25, 6) AS "t25", round(t90, 6) AS "t90" FROM (VALUES ('finals'), ('vowels'), ('letters')) r(model) LEFT JOIN (
             SELECT model, max(balanced_acc) FILTER (tau = 0) AS t0, max(balanced_acc) FILTER (tau = 0.25) AS t25, NULL::DOUBLE AS t90 FROM ex WHERE split_kind = 'doc' GROUP BY model) x USING (model)""",
        EXP,
    ),
)
def grid_runs(spark, sf):
    e = experiments(spark, sf).withColumn("col", F.concat(F.lit("t"), (F.col("tau") * 100).cast("int")))
    rows = spark.createDataFrame([("finals",), ("vowels",), ("letters",)], "model string")
    prefer = F.when(F.col("split_kind") == "doc", 0).otherwise(1)
    d = registry.grid_runs(e, rows, "model", "col", ["t0", "t25", "t90"], prefer, "balanced_acc")
    return d.select("model", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("t0", "t25", "t90")])


@query(
    "delta_vs_baseline",
    with_blocks(
        """SELECT ex.exp_id, round(100 * (ex.top1 - b.top1), 4) + 0.0 AS delta_top1, round(100 * (ex.balanced_acc - b.balanced_acc), 4) + 0.0 AS delta_balanced_acc FROM ex, ex b WHERE b.exp_id = 'vowels_t0_T4'""",
        EXP,
    ),
)
def delta_vs_baseline(spark, sf):
    d = registry.delta_vs_baseline(experiments(spark, sf), "vowels_t0_T4")
    return d.select("exp_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("delta_top1", "delta_balanced_acc")])


@query("remaining_runs", with_blocks("SELECT m || '_t' || t || k AS exp_id FROM (VALUES ('letters'), ('vowels')) a(m), (VALUES (0), (25), (90)) b(t), (VALUES ('_T4'), ('_doc')) c(k) WHERE m || '_t' || t || k NOT IN (SELECT exp_id FROM ex WHERE top1 IS NOT NULL)", EXP))
def remaining_runs(spark, sf):
    cfg = [(f"{m}_t{t}{k}",) for m in ("letters", "vowels") for t in (0, 25, 90) for k in ("_T4", "_doc")]
    return registry.remaining_runs(spark.createDataFrame(cfg, "exp_id string"), experiments(spark, sf))


@query(
    "seed_stats",
    with_blocks("SELECT model, count(*) AS n_runs, round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_std FROM (SELECT model, fold, avg((y = pred)::INT) AS a FROM po GROUP BY ALL) GROUP BY model", S.OOF),
)
def seed_stats(spark, sf):
    runs = S.oof_pred(spark, sf).groupBy("model", "fold").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return profile.seed_stats(runs, ["model"], ["accuracy"])


# --- run records -------------------------------------------------------------
def run_records(spark, sf):
    """Nested records of the unadjusted runs, with the tau sweep as a map."""
    e = experiments(spark, sf)
    sweep = F.map_from_entries(
        F.collect_list(F.struct(F.col("tau").cast("string").alias("k"), F.struct("top1", "balanced_acc", "macro_f1", "minority_acc").alias("v")))
    )
    maps = e.groupBy("model", "split_kind").agg(sweep.alias("tau_sweep"))
    plain = e.where("tau = 0").join(maps, ["model", "split_kind"])
    cfg = F.struct(
        "model", F.lit(64).alias("img_size"), F.lit("full").alias("mode"), F.lit("gray3").alias("channel_mode"), F.lit("none").alias("aug"), F.lit("ce").alias("loss"),
        F.lit("none").alias("sampler"), F.lit(0.0).alias("mixup"), F.lit(0.0).alias("cutmix"), "split_kind", F.lit(1.0).alias("subset_frac"), F.lit(42).alias("seed"),
    )
    return plain.select("exp_id", cfg.alias("cfg"), "top1", "balanced_acc", "macro_f1", "minority_acc", "tau_sweep", F.col("n").alias("params_total"))


def _stored_runs(spark, sf):
    path = scratch_path(spark, "runs")
    run_records(spark, sf).write.json(path)
    # a damaged record next to the good ones
    C.documents(spark, sf).select(F.concat(F.lit('{"exp_id": '), F.col("lang"))).distinct().write.mode("append").text(path)
    return path


_TB = "(SELECT tau FROM ex b WHERE b.model = ex.model AND b.split_kind = ex.split_kind ORDER BY balanced_acc DESC, tau LIMIT 1)"


@query(
    "collect_runs",
    with_blocks(
        f"""SELECT exp_id, model, split_kind, 'none' AS aug, '-' AS extra, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc, {_TB} AS tau_best,
             round((SELECT max(balanced_acc) FROM ex b WHERE b.model = ex.model AND b.split_kind = ex.split_kind), 6) AS tau_best_bal FROM ex WHERE tau = 0""",
        EXP,
    ),
)
def collect_runs(spark, sf):
    d = files.collect_runs(spark, _stored_runs(spark, sf))
    return d.select("exp_id", "model", "split_kind", "aug", "extra", *r6("top1", "balanced_acc"), "tau_best", *r6("tau_best_bal"))


@query("tau_grid", with_blocks("SELECT model || '_t0' || CASE split_kind WHEN 'doc' THEN '_doc' ELSE '_T4' END AS exp_id, tau, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc FROM ex", EXP))
def tau_grid(spark, sf):
    return registry.tau_grid(files.read_runs(spark, _stored_runs(spark, sf))).select("exp_id", "tau", *r6("top1", "balanced_acc"))


# --- epoch logs: one run per event type, one epoch per day --------------------
LOG = """
lg AS MATERIALIZED (SELECT event_type AS exp_id, day(ts)::BIGINT AS epoch, floor(sum(round(value * 100)::BIGINT)::DOUBLE * 100 / count(*)) / 10000 AS train_loss,
       floor(avg((value >= 10)::INT) * 10000) / 10000 AS val_top1, floor(avg((value >= 20)::INT) * 10000) / 10000 AS val_bal_acc,
       CASE WHEN event_type < 'p' THEN floor(avg((value >= 19)::INT) * 10000) / 10000 END AS ema_val_bal_acc FROM events GROUP BY event_type, day(ts))
"""


def epoch_rows(spark, sf):
    ev = table(spark, sf, "events")
    # cut to 4 digits from whole numbers, so the order of addition does not matter
    share = lambda t: F.floor(F.avg((F.col("value") >= t).cast("int")) * 10000) / 10000
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
    d = ev.groupBy(F.col("event_type").alias("exp_id"), F.dayofmonth("ts").alias("epoch")).agg(
        (F.floor(cents * 100 / F.count("*")) / 10000).alias("train_loss"), share(10).alias("val_top1"), share(20).alias("val_bal_acc"), share(19).alias("ema_val_bal_acc")
    )
    return d.withColumn("ema_val_bal_acc", F.when(F.col("exp_id") < "p", F.col("ema_val_bal_acc")))


def _stored_log(spark, sf):
    """Logs in three header shapes by the first letter of the run: all columns; another order with a column more; no averaged model."""
    path = scratch_path(spark, "epoch-log")
    d = epoch_rows(spark, sf).withColumn("lr", F.lit("n/a"))
    full = d.columns
    shapes = [
        ("exp_id < 'd'", full),
        ("exp_id >= 'd' and exp_id < 'p'", ["exp_id", "ema_val_bal_acc", "note", "val_bal_acc", "lr", "val_top1", "epoch", "train_loss"]),
        ("exp_id >= 'p'", [c for c in full if not c.startswith("ema_")]),
    ]
    for where, columns in shapes:
        own = d.where(where).withColumn("note", F.lit('free text, with a "quote"')).select(*columns)
        own.write.mode("append").partitionBy("exp_id").option("header", True).option("escape", '"').csv(path)
    return files.epoch_logs(spark, path)


@query("read_epoch_logs", with_blocks("SELECT exp_id, epoch, train_loss, val_top1, val_bal_acc, coalesce(ema_val_bal_acc, -1) AS ema_val_bal_acc, true AS lr_missing FROM lg", LOG))
def read_epoch_logs(spark, sf):
    d = _stored_log(spark, sf)
    return d.select("exp_id", *big("epoch"), "train_loss", "val_top1", "val_bal_acc", F.coalesce("ema_val_bal_acc", F.lit(-1.0)).alias("ema_val_bal_acc"), F.col("lr").isNull().alias("lr_missing"))


@query(
    "best_epoch",
    with_blocks(
        """SELECT exp_id, epoch, which, metric FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY metric DESC, epoch, o) AS r FROM (
             SELECT exp_id, epoch, 'raw' AS which, 0 AS o, val_bal_acc AS metric FROM lg UNION ALL SELECT exp_id, epoch, 'ema', 1, ema_val_bal_acc FROM lg WHERE ema_val_bal_acc IS NOT NULL)) WHERE r = 1""",
        LOG,
    ),
)
def best_epoch(spark, sf):
    return registry.best_epoch(epoch_rows(spark, sf)).select("exp_id", *big("epoch"), "which", "metric")


@query(
    "curves_of_best",
    with_blocks(
        """SELECT exp_id, epoch, val_top1, val_bal_acc FROM lg WHERE exp_id = 'click' OR exp_id = (SELECT exp_id FROM lg GROUP BY exp_id ORDER BY max(val_bal_acc) DESC, exp_id DESC LIMIT 1)""",
        LOG,
    ),
)
def curves_of_best(spark, sf):
    log = epoch_rows(spark, sf)
    exp = log.groupBy("exp_id").agg(F.max("val_bal_acc").alias("balanced_acc"))
    return registry.curves_of_best(exp, log, also=["click"]).select("exp_id", *big("epoch"), "val_top1", "val_bal_acc")


@query(
    "read_experiments",
    with_blocks("SELECT exp_id, model, split_kind, 'none' AS aug, 64.0::DOUBLE AS img_size, round(top1, 6) AS top1, true AS latency_missing FROM ex", EXP),
)
def read_experiments(spark, sf):
    path = scratch_path(spark, "experiments")
    e = experiments(spark, sf).select("exp_id", "model", "top1", F.lit("fast").alias("latency_ms"))
    e.write.option("header", True).csv(path)
    d = files.load_experiments(spark, path)
    return d.select("exp_id", "model", "split_kind", "aug", "img_size", *r6("top1"), F.col("latency_ms").isNull().alias("latency_missing"))


@query(
    "scan_manifest",
    """SELECT lang AS class, lang IN ('de', 'en', 'fr') AS known, true AS listed, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM documents GROUP BY lang""",
)
def scan_manifest(spark, sf):
    path = scratch_path(spark, "tree")
    # one write, one folder per class; "es" is no class of the universe
    d = C.documents(spark, sf).select("lang", F.regexp_replace("text", r"[\r\n]", " ").alias("value"), "source")
    d.repartition(32, "source").drop("source").write.partitionBy("lang").text(path)
    kept, skipped = files.scan_files(spark, path, ".txt", Classes.of(spark, ["lang=de", "lang=en", "lang=fr"]))
    listed = kept.groupBy("class").agg(F.count_distinct("path").alias("n_paths"), F.sum("bytes").alias("n_bytes"))
    other = skipped.where("reason = 'class'").groupBy("class").agg(F.count_distinct("path").alias("n_paths"), F.sum("bytes").alias("n_bytes"))
    both = listed.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False)))
    return both.select(F.regexp_replace("class", "lang=", "").alias("class"), "known", (F.col("n_paths") > 0).alias("listed"), "n_bytes")


@query(
    "write_split",
    """SELECT seed, lang, count(*) AS n, count(*) FILTER (rk <= round_even(0.2::DOUBLE * nc, 0)) AS n_val FROM (
             SELECT s.seed, lang, row_number() OVER (PARTITION BY s.seed, lang ORDER BY md5(s.seed || ':' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY s.seed, lang) AS nc
             FROM documents CROSS JOIN (VALUES (0::BIGINT), (1), (42)) s(seed)) GROUP BY ALL""",
)
def write_split(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "lang", "source")
    rows = S.dim(spark, sf).rows
    parts = split.seeded_splits(d, "lang", "doc_id", "source", seeds=(42, 0, 1), rows=rows)
    stored = sinks.write_splits(parts, scratch_path(spark, "splits"), "doc_id")
    return stored.groupBy(F.col("seed").cast("bigint").alias("seed"), "lang").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("n_val"))


@query(
    "write_report",
    with_blocks(
        """SELECT '| model | n | n_correct |' AS value UNION ALL SELECT '|---|---|---|'
           UNION ALL SELECT '| ' || model || ' | ' || count(*) || ' | ' || count(*) FILTER (y = pred) || ' |' FROM pd GROUP BY model""",
        S.PRED,
    ),
)
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    d = S.pred(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    sinks.write_report(d, path, "markdown", ["model"])
    return spark.read.text(path)


_REPORT = "SELECT model, count(*) AS n, count(*) FILTER (y = pred) AS n_correct FROM pd GROUP BY model"


def _report_query(fmt):
    @query(f"write_report_{fmt}", with_blocks(_REPORT, S.PRED))
    def run(spark, sf):
        path = scratch_path(spark, f"report-{fmt}")
        d = S.pred(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
        sinks.write_report(d, path, fmt, ["model"])
        back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.json(path)
        return back.select("model", *big("n", "n_correct"))

    return run


_report_query("csv")
_report_query("json")


@query("rejected_runs", """SELECT DISTINCT '{"exp_id": ' || lang AS text, false AS readable FROM documents WHERE lang IS NOT NULL""")
def rejected_runs(spark, sf):
    """The damaged records among the stored runs, with the file they are in."""
    d = files.rejected_runs(spark, _stored_runs(spark, sf))
    return d.select("text", F.col("path").isNull().alias("readable"))


@query(
    "scan_skipped",
    """SELECT lang AS class, CASE lang WHEN 'es' THEN 'class' ELSE 'extension' END AS reason, true AS listed FROM documents WHERE lang IN ('en', 'es') GROUP BY lang""",
)
def scan_skipped(spark, sf):
    """Files that a scan leaves out: those of a class outside the universe and compressed copies beside the kept ones."""
    path = scratch_path(spark, "tree")
    d = C.documents(spark, sf).select("lang", F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
    d.write.partitionBy("lang").text(path)
    d.where("lang = 'en'").write.mode("append").option("compression", "gzip").partitionBy("lang").text(path)
    _, skipped = files.scan_files(spark, path, ".txt", Classes.of(spark, ["lang=de", "lang=en", "lang=fr"]))
    per = skipped.groupBy("class", "reason").agg(F.count("*").alias("n"))
    return per.select(F.regexp_replace("class", "lang=", "").alias("class"), "reason", (F.col("n") > 0).alias("listed"))


def _per_class(batch):
    size = F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes")
    return batch.groupBy("lang", "label").agg(F.count("*").alias("n"), size, F.count_if(F.col("text").isNull()).alias("n_unreadable"))


@query(
    "stream_triage",
    """SELECT lang AS class, dense_rank() OVER (ORDER BY lang) - 1 AS label, count(*) AS n, coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes, count(*) FILTER (text IS NULL) AS n_unreadable
       FROM documents WHERE lang IS NOT NULL GROUP BY lang""",
)
def stream_triage(spark, sf):
    """Documents arrive in two deliveries; the query is stopped between them and goes on from its checkpoint."""
    docs = C.documents(spark, sf).select("doc_id", "lang", "text").where("lang is not null")
    landing, out, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("landing", "triage", "checkpoint"))
    for half in (0, 1):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).write.mode("append").parquet(landing)
        items = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(landing)
        named = join_class_dim(items, "lang", S.dim(spark, sf), "left")
        incoming.triage_batches(named, _per_class, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    totals = [F.sum("n").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.sum("n_unreadable").alias("n_unreadable")]
    return spark.read.parquet(out).groupBy(F.col("lang").alias("class"), F.col("label").cast("bigint").alias("label")).agg(*totals)
