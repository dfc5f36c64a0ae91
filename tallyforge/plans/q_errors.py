"""Error-analysis, label-noise and robustness queries."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.operators import errors, metrics, noise, overlay, score, stress
from tallyforge.plans import corpus as C
from tallyforge.plans import scoring as S
from tallyforge.plans.base import query, with_blocks
from tallyforge.plans.q_metrics import big, cells, nm, r6, rounded_sql

_CELLS = "ce AS (SELECT model, y, y_class, pred, pred_class, count(*) AS n, sum(count(*)) OVER (PARTITION BY model, y) AS ny FROM pd GROUP BY model, y, y_class, pred, pred_class)"


def rows(spark, sf):
    return S.dim(spark, sf).rows


@query(
    "confused_directed",
    with_blocks(
        """SELECT model, y_class, pred_class, n, round(100.0 * n / ny, 6) AS pct, n_train, r AS rank FROM (
             SELECT ce.*, tc.n AS n_train, row_number() OVER (PARTITION BY model ORDER BY ce.n DESC, 100.0::DOUBLE * ce.n / ny DESC, y, pred) AS r FROM ce JOIN tc ON tc.label = ce.y WHERE y <> pred) WHERE r <= 5""",
        S.PRED, _CELLS,
    ),
)
def confused_directed(spark, sf):
    d = errors.confused_directed(cells(spark, sf), ["model"], S.train_counts(spark, sf), rows(spark, sf), 5)
    return d.select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n", *r6("pct"), "n_train", *big("rank"))


@query(
    "confused_symmetric",
    with_blocks(
        """SELECT model, a, b, total, a_to_b, b_to_a, r AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY model ORDER BY total DESC, greatest(a_to_b, b_to_a) DESC, a, b) AS r FROM (
               SELECT model, least(y_class, pred_class) AS a, greatest(y_class, pred_class) AS b, sum(n)::BIGINT AS total,
                      coalesce(sum(n) FILTER (y < pred), 0)::BIGINT AS a_to_b, coalesce(sum(n) FILTER (y > pred), 0)::BIGINT AS b_to_a FROM ce WHERE y <> pred GROUP BY ALL)) WHERE r <= 4""",
        S.PRED, _CELLS,
    ),
)
def confused_symmetric(spark, sf):
    d = errors.confused_symmetric(cells(spark, sf), ["model"], 4)
    return d.select("model", nm(spark, sf, "a", "a"), nm(spark, sf, "b", "b"), "total", "a_to_b", "b_to_a", *big("rank"))


@query(
    "worst_classes",
    with_blocks(
        """SELECT model, y_class AS class, n_val, n_train, round(recall, 6) AS recall, top, r AS rank FROM (
             SELECT c.*, tc.n AS n_train, row_number() OVER (PARTITION BY model ORDER BY recall, n_val DESC, tc.n DESC, y) AS r FROM (
               SELECT model, y, y_class, sum(n)::BIGINT AS n_val, coalesce(sum(n) FILTER (y = pred), 0) / sum(n)::DOUBLE AS recall,
                      string_agg(pred_class || ':' || n, ',' ORDER BY n DESC, pred) FILTER (q <= 3) AS top
               FROM (SELECT *, row_number() OVER (PARTITION BY model, y ORDER BY n DESC, pred) AS q FROM ce) GROUP BY model, y, y_class) c JOIN tc ON tc.label = c.y) WHERE r <= 3""",
        S.PRED, _CELLS,
    ),
)
def worst_classes(spark, sf):
    d = errors.worst_classes(cells(spark, sf), ["model"], S.train_counts(spark, sf), rows(spark, sf), 3)
    dim = S.dim(spark, sf)
    top = F.array_join(F.transform("top", lambda t: F.concat_ws(":", score.named(t["pred"], dim), t["n"])), ",")
    return d.select("model", nm(spark, sf, "label", "class"), "n_val", "n_train", *r6("recall"), top.alias("top"), *big("rank"))


@query(
    "unevaluated_classes",
    with_blocks("SELECT class FROM dim WHERE label NOT IN (SELECT y FROM pd WHERE n_chars >= 15000)", S.PRED),
)
def unevaluated_classes(spark, sf):
    long_docs = S.pred(spark, sf).where("n_chars >= 15000")
    return errors.unevaluated_classes(metrics.confusion(long_docs, ["model"]), S.dim(spark, sf)).select("class")


@query(
    "per_class_report",
    with_blocks(
        """SELECT model, dim.class, any_value(tc.n) AS n_train, count(*) FILTER (y = dim.label) AS n_val, round(avg((pred = dim.label)::INT) FILTER (y = dim.label), 6) AS recall,
             round(avg((y = dim.label)::INT) FILTER (pred = dim.label), 6) AS precision, count(*) FILTER (y = dim.label) = 0 AS blind FROM pd CROSS JOIN dim JOIN tc ON tc.label = dim.label GROUP BY model, dim.class""",
        S.PRED,
    ),
)
def per_class_report(spark, sf):
    d = errors.per_class_report(cells(spark, sf), ["model"], S.train_counts(spark, sf), rows(spark, sf))
    return d.select("model", "class", "n_train", "n_val", *r6("recall", "precision"), "blind")


@query(
    "confusion_zoom",
    with_blocks(
        """SELECT model, y_class, pred_class, n FROM ce WHERE (model, y) IN (SELECT (model, label) FROM top) AND (model, pred) IN (SELECT (model, label) FROM top)""",
        S.PRED, _CELLS,
        """top AS (SELECT model, label FROM (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY sum(n) DESC, label) AS r
             FROM (SELECT model, y AS label, n FROM ce WHERE y <> pred UNION ALL SELECT model, pred, n FROM ce WHERE y <> pred) GROUP BY model, label) WHERE r <= 3)""",
    ),
)
def confusion_zoom(spark, sf):
    d = errors.confusion_zoom(cells(spark, sf), 3, ["model"])
    return d.select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n")


@query(
    "show_class",
    with_blocks("SELECT model, item_id, pred_class, count(*) OVER (PARTITION BY model, pred_class) AS n_mistaken, round(p1, 6) AS p1 FROM pd WHERE y_class = 'fr' AND pred_class <> 'fr'", S.PRED),
)
def show_class(spark, sf):
    d = errors.show_class(S.pred(spark, sf), S.dim(spark, sf).require_names().index("fr"))
    return d.select("model", "item_id", nm(spark, sf, "pred", "pred_class"), "n_mistaken", *r6("p1"))


@query(
    "confident_mistakes",
    with_blocks(
        """SELECT model, list, item_id, y_class, pred_class, round(p1, 5) AS p1 FROM (
             SELECT *, 'wrong_sure' AS list, row_number() OVER (PARTITION BY model ORDER BY p1 DESC, item_id) AS r FROM pd WHERE y <> pred
             UNION ALL SELECT *, 'right_unsure', row_number() OVER (PARTITION BY model ORDER BY p1, item_id) FROM pd WHERE y = pred) WHERE r <= 15""",
        S.PRED,
    ),
)
def confident_mistakes(spark, sf):
    d = errors.confident_mistakes(S.pred(spark, sf), "item_id", 15, ["model"])
    return d.select("model", "list", "item_id", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), F.round("p1", 5).alias("p1"))


# --- label noise -------------------------------------------------------------
@query(
    "oof_assemble",
    with_blocks("SELECT model, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, 0::BIGINT AS n_repeated, round(avg((y = pred)::INT), 6) AS accuracy, count(*) FILTER (y <> pred) AS n_disagree FROM po GROUP BY model", S.OOF),
)
def oof_assemble(spark, sf):
    d = noise.oof_assemble(S.oof_pred(spark, sf), ["model"], "item_id")
    return d.select("model", "n_rows", "n_items", "n_repeated", *r6("accuracy"), "n_disagree")


NOISE = S.OOF + ",\nnc AS (SELECT * FROM po WHERE y <> pred AND p1 >= 0.70)"


def candidates(spark, sf):
    """The candidates of all models, settled: a fix plan reads them several times, the scores once."""

    def make():
        return settle(noise.noise_candidates(S.oof_pred(spark, sf)).drop("scores", "probs"), "candidates")

    c = S._once(spark, sf, "candidates", make)
    return c.withColumn("key", F.col("item_id")).withColumn("y_class", nm(spark, sf, "y", "y_class")).withColumn("pred_class", nm(spark, sf, "pred", "pred_class"))


@query(
    "noise_candidates",
    with_blocks("SELECT model, item_id, y_class, pred_class, round(p_true, 6) AS p_true, round(p1, 6) AS p_pred, round(p1 - p_true, 6) AS margin, fold FROM nc", NOISE),
)
def noise_candidates(spark, sf):
    return candidates(spark, sf).select("model", "item_id", "y_class", "pred_class", *r6("p_true", "p_pred", "margin"), *big("fold"))


@query(
    "noise_pairs",
    with_blocks(
        """SELECT model, y_class, pred_class, count(*) AS n, round(avg(p1), 6) AS mean_conf, round(avg(p1 - p_true), 6) AS mean_margin,
                  CASE WHEN avg(p1) > 0.75 AND count(*) >= 5 THEN 'relabel' ELSE 'review' END AS suggestion FROM nc GROUP BY ALL""",
        NOISE,
    ),
)
def noise_pairs(spark, sf):
    d = noise.noise_pairs(candidates(spark, sf), ["model"], conf=0.75)
    return d.select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n", *r6("mean_conf", "mean_margin"), "suggestion")


@query(
    "undisputed_reference",
    with_blocks(
        """SELECT model, doc_id, CASE lang WHEN 'es' THEN 'reference_a' ELSE 'reference_b' END AS role FROM (
              SELECT model, doc_id, lang, row_number() OVER (PARTITION BY model, lang ORDER BY md5('42:' || doc_id), doc_id) AS r
              FROM documents CROSS JOIN (VALUES ('finals'), ('lengths'), ('vowels')) mm(model) WHERE lang IN ('es', 'en') AND (model, doc_id) NOT IN (SELECT (model, item_id) FROM nc)) WHERE r <= 8
           UNION ALL SELECT model, item_id, 'disputed' FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p1 DESC, item_id) AS r FROM nc WHERE y_class = 'es' AND pred_class = 'en') WHERE r <= 8""",
        NOISE,
    ),
)
def undisputed_reference(spark, sf):
    cand = candidates(spark, sf).withColumn("doc_id", F.col("item_id"))
    return noise.undisputed_reference(C.documents(spark, sf).select("doc_id", "lang"), cand, "doc_id", "lang", ("es", "en"), models=("finals", "lengths", "vowels"))


# reviewed verdicts: the second label table stands in for the reviewer
_REVIEW = "rv AS (SELECT DISTINCT nc.item_id AS key, CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'relabel' ELSE 'keep' END AS verdict FROM nc JOIN labels l ON l.doc_id = nc.item_id)"
_ACTIONS = """ac AS (SELECT key, action, from_class, to_class FROM (
       SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(r, 3), p1 DESC, to_class, from_class) AS k FROM (
         SELECT nc.item_id AS key, coalesce(CASE WHEN rv.verdict IN ('drop', 'relabel') THEN rv.verdict END, CASE tp.r WHEN 1 THEN 'relabel' WHEN 2 THEN 'drop' END) AS action,
                nc.y_class AS from_class, nc.pred_class AS to_class, nc.p1, CASE WHEN tp.r <= 2 THEN tp.r END AS r
         FROM nc LEFT JOIN rv ON rv.key = nc.item_id
         LEFT JOIN (SELECT y, pred, row_number() OVER (ORDER BY n DESC, y, pred) AS r FROM (SELECT y, pred, count(*) AS n FROM nc GROUP BY ALL)) tp ON tp.y = nc.y AND tp.pred = nc.pred)
       WHERE action IS NOT NULL) WHERE k = 1)"""


def _actions(spark, sf):
    """One action per item on the candidates of all models."""
    from pyspark.sql import Window

    from tallyforge.plans.base import table

    cand = candidates(spark, sf)
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "relabel").otherwise("keep").alias("verdict")
    )
    reviewed = lab.join(cand.select("key"), "key", "left_semi")
    # the reviewer reads the pair table and confirms the first pair, then gives up on the second
    first = F.row_number().over(Window.orderBy(F.desc("n"), "y", "pred"))
    top = noise.noise_pairs(cand).withColumn("priority", first).where("priority <= 2")
    action = F.when(F.col("priority") == 1, "relabel").otherwise("drop").alias("action")
    listed = top.select(nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), action, "priority")
    return overlay.plan_fixes(cand, S.dim(spark, sf), reviewed, listed=listed)


@query("plan_fixes", with_blocks("SELECT * FROM ac WHERE action IS NOT NULL", NOISE, _REVIEW, _ACTIONS))
def plan_fixes(spark, sf):
    return _actions(spark, sf)


@query(
    "apply_fixes",
    with_blocks(
        """SELECT doc_id, CASE WHEN ac.action = 'relabel' THEN ac.to_class ELSE lang END AS lang, dim.label FROM documents LEFT JOIN ac ON ac.key = doc_id
           JOIN dim ON dim.class = CASE WHEN ac.action = 'relabel' THEN ac.to_class ELSE lang END WHERE coalesce(ac.action, '') <> 'drop'""",
        NOISE, _REVIEW, _ACTIONS,
    ),
)
def apply_fixes(spark, sf):
    d = overlay.apply_fixes(C.documents(spark, sf).select("doc_id", "lang"), _actions(spark, sf), "doc_id", "lang", S.dim(spark, sf))
    return d.select("doc_id", "lang", *big("label"))


@query(
    "exclude_eval",
    with_blocks(
        rounded_sql(S.metrics_sql("px", "model", counts=""), "model", "top1,balanced_acc,macro_f1", "n"),
        S.PRED, C.RELABELLED,
        "px AS (SELECT pd.* FROM pd JOIN documents d ON d.doc_id = pd.item_id LEFT JOIN relabelled r ON r.doc_id = pd.item_id WHERE r.lang IS NOT DISTINCT FROM d.lang)",
    ),
)
def exclude_eval(spark, sf):
    a = C.documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("name"), "lang")
    b = C.relabelled(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "lang")
    changes = overlay.change_list(overlay.diff_labels(a, b, "doc_id", "name", "lang"))
    kept = S.pred(spark, sf).join(changes.select(F.col("key").alias("item_id")), "item_id", "left_anti")
    return metrics.metrics_of(kept, ["model"]).select("model", "n", *r6("top1", "balanced_acc", "macro_f1"))


# --- robustness --------------------------------------------------------------
SM = (
    S.SWEEP
    + ",\nsm AS MATERIALIZED (SELECT l.*, m.* EXCLUDE (model, condition, severity) FROM (SELECT model, condition, severity, count(*) FILTER (known = 0) AS n_rejected FROM ps GROUP BY ALL) l LEFT JOIN ("
    + S.metrics_sql("(SELECT * FROM ps WHERE known > 0)", "model, condition, severity", counts="")
    + ") m USING (model, condition, severity))"
)
RET = SM + ",\nrt AS (SELECT sm.*, c.top1 AS clean_top1, sm.top1 / c.top1 AS retention FROM sm JOIN sm c ON c.model = sm.model AND c.condition = 'clean')"
HARD = "CASE condition WHEN 'clip' THEN -severity ELSE severity END"


@query(
    "perturb_sweep",
    with_blocks("SELECT model, condition, severity, coalesce(n, 0) AS n, n_rejected, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc, round(macro_f1, 6) AS macro_f1 FROM sm", SM),
)
def perturb_sweep(spark, sf):
    return S.sweep_metrics(spark, sf).select("model", "condition", "severity", "n", "n_rejected", *r6("top1", "balanced_acc", "macro_f1"))


@query(
    "sweep_cross",
    with_blocks("SELECT condition, severity, (SELECT count(*) FROM documents) AS n_items, (SELECT sum(n_chars) FROM documents)::BIGINT AS n_chars FROM (SELECT DISTINCT condition, severity FROM gi)", S.SWEEP),
)
def sweep_cross(spark, sf):
    items = C.documents(spark, sf).select(F.col("doc_id").alias("item_id"), "n_chars")
    return stress.sweep_cross(items).groupBy("condition", "severity").agg(F.count("*").alias("n_items"), F.sum("n_chars").alias("n_chars"))


@query(
    "harshness_key",
    with_blocks(f"SELECT model, condition, severity, row_number() OVER (PARTITION BY model, condition ORDER BY {HARD}) AS step FROM sm", SM),
)
def harshness_key(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("model", "condition").orderBy(stress.harshness(F.col("condition"), F.col("severity")))
    d = S.sweep_metrics(spark, sf).withColumn("step", F.row_number().over(w))
    return d.select("model", "condition", "severity", *big("step"))


@query("retention", with_blocks("SELECT model, condition, severity, round(clean_top1, 6) AS clean_value, round(retention, 6) AS retention FROM rt", RET))
def retention(spark, sf):
    return stress.retention(S.sweep_metrics(spark, sf)).select("model", "condition", "severity", *r6("clean_value", "retention"))


@query(
    "crossing_points",
    with_blocks(
        f"""SELECT model, condition, arg_min(severity, {HARD}) FILTER (retention < 0.9) AS below_90, arg_min(severity, {HARD}) FILTER (retention < 0.5) AS below_50
            FROM rt WHERE condition <> 'clean' GROUP BY ALL""",
        RET,
    ),
)
def crossing_points(spark, sf):
    return stress.crossing_points(stress.retention(S.sweep_metrics(spark, sf)))


@query(
    "worst_severity",
    with_blocks(
        f"""SELECT model, condition, severity AS worst_severity, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc, round(c_top1 - top1, 6) AS drop_top1, round(round(c_bal, 9) - round(balanced_acc, 9), 6) AS drop_balanced,
              round(mean_top1, 6) AS mean_top1, row_number() OVER (PARTITION BY model ORDER BY round(balanced_acc, 9), condition) AS damage_rank FROM (
            SELECT sm.*, c.top1 AS c_top1, c.balanced_acc AS c_bal, avg(sm.top1) OVER (PARTITION BY sm.model) AS mean_top1, row_number() OVER (PARTITION BY sm.model, sm.condition ORDER BY round(sm.balanced_acc, 9), CASE sm.condition WHEN 'clip' THEN -sm.severity ELSE sm.severity END) AS r
            FROM sm JOIN sm c ON c.model = sm.model AND c.condition = 'clean' WHERE sm.condition <> 'clean') WHERE r = 1""",
        SM,
    ),
)
def worst_severity(spark, sf):
    m = S.sweep_metrics(spark, sf).withColumn("balanced_acc", F.round("balanced_acc", 9))
    d = stress.worst_severity(m)
    return d.select("model", "condition", "worst_severity", *r6("top1", "balanced_acc", "drop_top1", "drop_balanced", "mean_top1"), *big("damage_rank"))


IM = S.SWEEP + """,
ic AS (SELECT model, condition, severity, y, y_class, pred, pred_class, count(*) AS n, sum(p1) AS c FROM ps GROUP BY ALL),
im AS (SELECT model, condition || '@' || (severity * 100)::INT AS transform, y_class, max(pred_class) FILTER (r = 1) AS maps_to, sum(n)::BIGINT AS n, max(n) / sum(n)::DOUBLE AS rate, sum(c) / sum(n) AS mean_conf
       FROM (SELECT *, row_number() OVER (PARTITION BY model, condition, severity, y ORDER BY n DESC, pred) AS r FROM ic) GROUP BY ALL)"""


@query("identity_map", with_blocks("SELECT model, transform, y_class, maps_to, y_class = maps_to AS maps_to_self, n, round(rate, 6) AS rate, round(mean_conf, 6) AS mean_conf FROM im", IM))
def identity_map(spark, sf):
    d = _identity(spark, sf)
    return d.select("model", "transform", nm(spark, sf, "y", "y_class"), nm(spark, sf, "maps_to", "maps_to"), "maps_to_self", "n", *r6("rate", "mean_conf"))


def _identity(spark, sf):
    p = S.sweep_pred(spark, sf)
    label = F.concat(F.col("condition"), F.lit("@"), (F.col("severity") * 100).cast("int").cast("string"))
    return stress.identity_map(p.withColumn("transform", label), "transform")


@query(
    "silent_failures",
    with_blocks("SELECT transform, y_class, maps_to, count(*) AS n_models FROM im WHERE y_class <> maps_to AND rate >= 0.6 AND mean_conf >= 0.6 GROUP BY ALL", IM),
)
def silent_failures(spark, sf):
    d = stress.silent_failures(_identity(spark, sf), "transform", conf=0.6)
    return d.select("transform", nm(spark, sf, "y", "y_class"), nm(spark, sf, "maps_to", "maps_to"), "n_models")


@query(
    "dangerous_counts",
    with_blocks(
        """SELECT transform, """
        + ", ".join(f"count(*) FILTER (model = '{m}' AND y_class <> maps_to AND rate >= 0.5 AND mean_conf >= 0.6) AS {m}" for m in ("finals", "lengths", "vowels"))
        + " FROM im GROUP BY transform",
        IM,
    ),
)
def dangerous_counts(spark, sf):
    return stress.dangerous_counts(_identity(spark, sf), ["finals", "lengths", "vowels"], "transform", conf=0.6)


@query(
    "best_under",
    with_blocks("SELECT model, round(avg(retention), 6) AS mean_retention, row_number() OVER (ORDER BY round(avg(retention), 9) DESC, model) AS rank FROM rt WHERE condition IN ('clip', 'strip') GROUP BY model", RET),
)
def best_under(spark, sf):
    d = stress.best_under(stress.retention(S.sweep_metrics(spark, sf)), ["clip", "strip"])
    return d.select("model", *r6("mean_retention"), *big("rank"))
