"""Score, metric, ensemble and view queries."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import small
from tallyforge.operators import ensemble, metrics, sample, score
from tallyforge.plans import corpus as C
from tallyforge.plans import scoring as S
from tallyforge.plans.base import query, with_blocks


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def big(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def cut4(col):
    # exact scores lie on decimal ties, where engines round differently; cutting is the same everywhere
    return (F.floor(F.col(col) * 10000) / 10000).alias(col)


def nm(spark, sf, col, alias):
    return score.named(F.col(col), S.dim(spark, sf)).alias(alias)


MET = ["top1", "topk", "balanced_acc", "macro_f1", "minority_acc", "minority_macro"]


def rounded_sql(inner: str, keys: str, cols: str = ",".join(MET), rest: str = "n, n_classes_present") -> str:
    return f"SELECT {keys}, {rest}, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols.split(",")) + f" FROM ({inner})"


@query("batch_score", with_blocks("SELECT model, item_id, y_class, class, floor(score * 10000) / 10000 AS score FROM sc", S.SCORES))
def batch_score(spark, sf):
    long = score.to_long(S.scores(spark, sf), "scores", "score", "model", "item_id", "y")
    return long.select("model", "item_id", nm(spark, sf, "y", "y_class"), nm(spark, sf, "label", "class"), cut4("score"))


@query(
    "batch_score_python",
    with_blocks("SELECT item_id, model, floor(max(score) * 10000) / 10000 AS best FROM sc GROUP BY ALL", S.SCORES),
)
def batch_score_python(spark, sf):
    def make():
        import numpy as np

        def fn(pdf):
            best = np.vstack(pdf["scores"].to_numpy()).max(axis=1) if len(pdf) else []
            return pdf[["item_id", "model"]].assign(best=best)

        return fn

    d = S.scores(spark, sf).select("item_id", "model", "scores")
    out = score.batch_score(d, make, "item_id bigint, model string, best double")
    return out.withColumn("best", cut4("best"))


@query("softmax", with_blocks("SELECT model, item_id, class, round(p, 6) AS prob FROM pdb", S.PRED))
def softmax(spark, sf):
    long = score.to_long(score.softmax(S.scores(spark, sf)), "probs", "prob", "model", "item_id")
    return long.select("model", "item_id", nm(spark, sf, "label", "class"), *r6("prob"))


_PRIOR = "lpv AS (SELECT label, ln(greatest(n, 1)::DOUBLE / (SELECT sum(n) FROM tc)) AS lp FROM tc)"


def log_priors(spark, sf):
    return sample.log_prior(S.train_counts(spark, sf))


@query(
    "logit_adjust",
    with_blocks("SELECT model, item_id, class, 0.5::DOUBLE AS tau, round(score - 0.5::DOUBLE * lpv.lp, 5) AS score FROM sc JOIN lpv USING (label)", S.SCORES, _PRIOR),
)
def logit_adjust(spark, sf):
    d = score.logit_adjust(S.scores(spark, sf), log_priors(spark, sf), 0.5)
    long = score.to_long(d, "scores", "score", "model", "item_id", "tau")
    return long.select("model", "item_id", "tau", nm(spark, sf, "label", "class"), F.round("score", 5).alias("score"))


@query("predict_argmax", with_blocks("SELECT model, item_id, y_class, pred_class FROM pd", S.PRED))
def predict_argmax(spark, sf):
    return S.pred(spark, sf).select("model", "item_id", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"))


@query(
    "prediction_table",
    with_blocks(
        """SELECT model, item_id, y_class, pred_class, runner_up, y = pred AS correct, round(p1, 6) AS p1, round(p1 - p2, 6) AS margin, rank_true, tc.n AS n_train
           FROM pd JOIN tc ON tc.label = pd.y""",
        S.PRED,
    ),
)
def prediction_table(spark, sf):
    n = S.train_counts(spark, sf).select(F.col("label").alias("y"), F.col("n").alias("n_train"))
    d = S.pred(spark, sf).join(small(n, S.dim(spark, sf).rows), "y")
    return d.select(
        "model", "item_id", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), nm(spark, sf, "runner_up", "runner_up"),
        "correct", *r6("p1", "margin"), *big("rank_true"), "n_train",
    )


@query("confidence_by_outcome", with_blocks("SELECT model, y = pred AS correct, count(*) AS n, round(avg(p1), 6) AS mean_conf FROM pd GROUP BY ALL", S.PRED))
def confidence_by_outcome(spark, sf):
    return S.pred(spark, sf).groupBy("model", "correct").agg(F.count("*").alias("n"), F.round(F.avg("p1"), 6).alias("mean_conf"))


@query("predict_topk", with_blocks("SELECT model, item_id, rk AS rank, class, round(p, 6) AS prob FROM pdb WHERE rk <= 3", S.PRED))
def predict_topk(spark, sf):
    d = score.predict_topk(S.scores(spark, sf), ["model", "item_id"], 3)
    return d.select("model", "item_id", *big("rank"), nm(spark, sf, "label", "class"), *r6("prob"))


@query("top1_topk_acc", with_blocks("SELECT model, count(*) AS n, round(avg((y = pred)::INT), 6) AS top1, round(avg((rank_true <= 2)::INT), 6) AS top2 FROM pd GROUP BY model", S.PRED))
def top1_topk_acc(spark, sf):
    return S.pred(spark, sf).groupBy("model").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("top1"),
        F.round(F.avg((F.col("rank_true") <= 2).cast("int")), 6).alias("top2"),
    )


def cells(spark, sf, keys=("model",)):
    return metrics.confusion(S.pred(spark, sf), keys, 2)


@query(
    "per_class_recall",
    with_blocks("SELECT model, dim.class, count(*) FILTER (y = label) AS n_true, round(avg((pred = label)::INT) FILTER (y = label), 6) AS recall FROM pd CROSS JOIN dim GROUP BY ALL", S.PRED),
)
def per_class_recall(spark, sf):
    d = metrics.class_metrics(cells(spark, sf), ["model"])
    return d.select("model", nm(spark, sf, "label", "class"), "n_true", *r6("recall"))


def _metric_query(name, cols):
    @query(name, with_blocks(rounded_sql(S.metrics_sql("pd", "model", S.MINORITY, 2), "model", ",".join(cols), "n"), S.PRED))
    def run(spark, sf):
        m = metrics.compute_metrics(S.scores(spark, sf), ["model"], S.train_counts(spark, sf), S.dim(spark, sf).rows, S.MINORITY, 2)
        return m.select("model", "n", *r6(*cols))

    return run


_metric_query("top1", ["top1"])
_metric_query("topk_acc", ["topk"])
_metric_query("balanced_acc", ["balanced_acc"])
_metric_query("macro_f1", ["macro_f1"])
_metric_query("minority_acc", ["minority_acc"])
_metric_query("minority_macro", ["minority_macro"])


@query("compute_metrics", with_blocks(rounded_sql(S.metrics_sql("pd", "model", S.MINORITY, 2), "model"), S.PRED))
def compute_metrics(spark, sf):
    m = metrics.compute_metrics(S.scores(spark, sf), ["model"], S.train_counts(spark, sf), S.dim(spark, sf).rows, S.MINORITY, 2)
    return m.select("model", "n", "n_classes_present", *r6(*MET))


@query("confusion", with_blocks("SELECT model, y_class, pred_class, count(*) AS n FROM pd GROUP BY ALL", S.PRED))
def confusion(spark, sf):
    return cells(spark, sf).select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n")


@query(
    "confusion_dense",
    with_blocks("SELECT m.model, a.class AS y_class, b.class AS pred_class, count(pd.item_id) AS n FROM (SELECT DISTINCT model FROM pd) m CROSS JOIN dim a CROSS JOIN dim b LEFT JOIN pd ON pd.model = m.model AND pd.y = a.label AND pd.pred = b.label GROUP BY ALL", S.PRED),
)
def confusion_dense(spark, sf):
    d = metrics.confusion_dense(cells(spark, sf), S.dim(spark, sf), ["model"])
    return d.select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n")


@query("confusion_norm", with_blocks("SELECT model, y_class, pred_class, round(n / sum(n) OVER (PARTITION BY model, y_class), 6) AS share FROM (SELECT model, y_class, pred_class, count(*) AS n FROM pd GROUP BY ALL)", S.PRED))
def confusion_norm(spark, sf):
    d = metrics.confusion_norm(cells(spark, sf), ["model"])
    return d.select("model", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), *r6("share"))


_TAUS = (0.0, 0.25, 0.5, 0.75)
TAU = ",\n".join(
    (
        S.SCORES, _PRIOR,
        "ta AS (SELECT sc.* EXCLUDE (score), t.tau, score - t.tau * lpv.lp AS score FROM sc JOIN lpv USING (label) CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75)) t(tau))",
        S.pred_sql("ta", "item_id, tau", "pt_"),
    )
)


def _sweep(spark, sf):
    return metrics.tau_sweep(S.scores(spark, sf), log_priors(spark, sf), ["model"], S.train_counts(spark, sf), S.dim(spark, sf).rows, _TAUS, S.MINORITY)


@query("tau_sweep", with_blocks(rounded_sql(S.metrics_sql("pt_", "model, tau", S.MINORITY), "model, tau", "top1,balanced_acc,macro_f1,minority_acc", "n"), TAU))
def tau_sweep(spark, sf):
    return _sweep(spark, sf).select("model", "tau", "n", *r6("top1", "balanced_acc", "macro_f1", "minority_acc"))


@query(
    "tau_best",
    with_blocks(f"SELECT model, tau, round(balanced_acc, 6) AS balanced_acc FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(balanced_acc, 9) DESC, tau) AS r FROM ({S.metrics_sql('pt_', 'model, tau', S.MINORITY)})) WHERE r = 1", TAU),
)
def tau_best(spark, sf):
    d = _sweep(spark, sf).withColumn("balanced_acc", F.round("balanced_acc", 9))
    return metrics.tau_best(d, ["model"]).select("model", "tau", *r6("balanced_acc"))


@query(
    "soft_targets",
    with_blocks(
        "SELECT item_id, class, round(avg(p), 6) AS target FROM (SELECT *, e / sum(e) OVER (PARTITION BY model, item_id) AS p FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY model, item_id)) / 4.0::DOUBLE) AS e FROM sc)) GROUP BY ALL",
        S.SCORES,
    ),
)
def soft_targets(spark, sf):
    d = score.soft_targets(S.scores(spark, sf), ["item_id"], S.dim(spark, sf).rows)
    return score.to_long(d, "probs", "target", "item_id").select("item_id", nm(spark, sf, "label", "class"), *r6("target"))


@query(
    "loss_table",
    with_blocks(
        """SELECT model, count(*) AS n, round(avg(ce), 6) AS ce, round(avg(0.9::DOUBLE * ce + 0.1::DOUBLE * mall), 6) AS ce_smooth, round(sum(w * ce) / sum(w), 6) AS ce_weighted,
                  round(avg(pow(1 - exp(-ce), 2) * ce), 6) AS focal, round(avg(cb * pow(1 - exp(-ce), 2) * ce), 6) AS cb_focal
           FROM (SELECT model, item_id, max(score) + ln(sum(e)) - max(score) FILTER (label = y) AS ce, max(score) + ln(sum(e)) - avg(score) AS mall, any_value(y) AS y FROM pdb GROUP BY ALL) JOIN lw ON lw.label = y GROUP BY model""",
        S.PRED,
        """lw AS (SELECT label, pow(n, -0.5::DOUBLE) / (SELECT avg(pow(n, -0.5::DOUBLE)) FROM tc) AS w,
                  ((1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n))) / (SELECT avg((1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n))) FROM tc) AS cb FROM tc)""",
    ),
)
def loss_table(spark, sf):
    counts = S.train_counts(spark, sf)
    w = sample.class_weights(counts, 0.5).select("label", "weight")
    w = w.join(sample.cb_weights(counts).select("label", F.col("weight").alias("cb_weight")), "label")
    d = score.loss_table(S.scores(spark, sf), ["model"], w, S.dim(spark, sf).rows)
    return d.select("model", "n", *r6("ce", "ce_smooth", "ce_weighted", "focal", "cb_focal"))


def _ens_sql(how):
    v = "ln(avg(p) + 1e-9::DOUBLE)" if how == "soft" else "avg(score)"
    return ",\n".join((S.PRED, f"en AS (SELECT item_id, 'all' AS model, y, y_class, class, label, {v} AS score, any_value(known) AS known FROM pdb GROUP BY ALL)".replace(", any_value(known) AS known FROM pdb GROUP BY ALL", ", max(known) AS known FROM pdb GROUP BY item_id, y, y_class, class, label"), S.pred_sql("en", "item_id", "pe")))


def _ens_query(name, how):
    @query(name, with_blocks("SELECT item_id, y_class, pred_class, round(p1, 6) AS p1 FROM pe", _ens_sql(how)))
    def run(spark, sf):
        d = score.predict(ensemble.ensemble(S.scores(spark, sf), ["item_id"], how, S.dim(spark, sf).rows))
        return d.select("item_id", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), *r6("p1"))

    return run


_ens_query("ensemble_soft", "soft")
_ens_query("ensemble_logit", "logit")

_MODELS = ("finals", "lengths", "vowels")
_SUBSETS = "(VALUES ('finals+lengths', 'finals'), ('finals+lengths', 'lengths'), ('finals+vowels', 'finals'), ('finals+vowels', 'vowels'), ('lengths+vowels', 'lengths'), ('lengths+vowels', 'vowels'), ('finals+lengths+vowels', 'finals'), ('finals+lengths+vowels', 'lengths'), ('finals+lengths+vowels', 'vowels')) s(subset, member)"


def _subset_sql(how):
    v = "ln(avg(p) + 1e-9::DOUBLE)" if how == "soft" else "avg(score)"
    return ",\n".join((
        S.PRED,
        f"en AS (SELECT subset, item_id, 'all' AS model, y, y_class, class, label, {v} AS score, max(known) AS known FROM pdb JOIN {_SUBSETS} ON s.member = pdb.model GROUP BY subset, item_id, y, y_class, class, label)",
        S.pred_sql("en", "item_id, subset", "pe"),
    ))


def _subset_query(name, how):
    @query(name, with_blocks(rounded_sql(S.metrics_sql("pe", "subset", S.MINORITY, 2), "subset", "top1,balanced_acc,macro_f1,minority_acc", "n"), _subset_sql(how)))
    def run(spark, sf):
        d = ensemble.ensemble_subsets(S.scores(spark, sf), _MODELS, ["item_id"], how, S.dim(spark, sf).rows)
        m = metrics.compute_metrics(d, ["subset"], S.train_counts(spark, sf), S.dim(spark, sf).rows, S.MINORITY, 2)
        return m.select("subset", "n", *r6("top1", "balanced_acc", "macro_f1", "minority_acc"))

    return run


_subset_query("ensemble_subsets", "soft")
_subset_query("ensemble_subsets_logit", "logit")


SUBSET_SWEEP = ",\n".join((
    S.PRED, _PRIOR,
    f"en AS (SELECT subset, item_id, 'all' AS model, y, y_class, class, label, ln(avg(p) + 1e-9::DOUBLE) AS soft, avg(score) AS logit, max(known) AS known FROM pdb JOIN {_SUBSETS} ON s.member = pdb.model GROUP BY subset, item_id, y, y_class, class, label)",
    """ew AS (SELECT en.* EXCLUDE (soft, logit), 'soft' AS how, t.tau, soft - t.tau * lpv.lp AS score FROM en JOIN lpv USING (label) CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75)) t(tau)
           UNION ALL SELECT en.* EXCLUDE (soft, logit), 'logit', 0.0::DOUBLE, logit FROM en)""",
    S.pred_sql("ew", "item_id, subset, how, tau", "pe"),
))


@query("ensemble_subset_sweep", with_blocks(rounded_sql(S.metrics_sql("pe", "subset, how, tau", S.MINORITY, 2), "subset, how, tau", "top1,balanced_acc,macro_f1,minority_acc", "n"), SUBSET_SWEEP))
def ensemble_subset_sweep(spark, sf):
    d = ensemble.subset_sweep(S.scores(spark, sf), _MODELS, ["item_id"], log_priors(spark, sf), _TAUS)
    m = metrics.compute_metrics(d, ["subset", "how", "tau"], S.train_counts(spark, sf), S.dim(spark, sf).rows, S.MINORITY, 2)
    return m.select("subset", "how", "tau", "n", *r6("top1", "balanced_acc", "macro_f1", "minority_acc"))


@query(
    "view_average",
    with_blocks(
        """SELECT model, item_id, class, round(avg(p), 6) AS prob FROM psb WHERE condition IN ('clean', 'strip') GROUP BY model, item_id, class""",
        S.SWEEP,
    ),
)
def view_average(spark, sf):
    v = S.sweep_scores(spark, sf).where(F.col("condition").isin("clean", "strip"))
    d = ensemble.view_average(v, ["model", "item_id"], "severity", S.dim(spark, sf).rows)
    return score.to_long(d, "probs", "prob", "model", "item_id").select("model", "item_id", nm(spark, sf, "label", "class"), *r6("prob"))


VIEWS = S.SWEEP + ",\nvw AS (SELECT *, (severity * 15)::BIGINT AS angle FROM ps WHERE condition IN ('clean', 'strip'))"


@query(
    "best_of_views",
    with_blocks("SELECT model, item_id, angle, pred_class, round(p1, 6) AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY model, item_id ORDER BY p1 DESC, angle) AS r FROM vw) WHERE r = 1", VIEWS),
)
def best_of_views(spark, sf):
    d = ensemble.best_of_views(S.views_pred(spark, sf), ["model", "item_id"], "angle")
    return d.select("model", "item_id", *big("angle"), nm(spark, sf, "pred", "pred_class"), *r6("p1"))


@query(
    "guarded_view_search",
    with_blocks(
        """SELECT b.model, b.item_id, b.p1 < 0.85 AS searched, coalesce(o.angle, 0) AS angle, coalesce(o.pred_class, b.pred_class) AS pred_class, round(coalesce(o.p1, b.p1), 6) AS p1
           FROM (SELECT * FROM vw WHERE angle = 0) b LEFT JOIN (
             SELECT v.*, row_number() OVER (PARTITION BY v.model, v.item_id ORDER BY v.p1 DESC, v.angle) AS r FROM vw v JOIN vw b ON b.model = v.model AND b.item_id = v.item_id AND b.angle = 0
             WHERE v.angle > 0 AND b.p1 < 0.85 AND v.p1 > b.p1 + 0.05) o ON o.model = b.model AND o.item_id = b.item_id AND o.r = 1""",
        VIEWS,
    ),
)
def guarded_view_search(spark, sf):
    d = ensemble.guarded_view_search(S.views_pred(spark, sf), ["model", "item_id"], "angle", margin=0.05)
    return d.select("model", "item_id", "searched", *big("angle"), nm(spark, sf, "pred", "pred_class"), *r6("p1"))


@query(
    "slice_metrics",
    with_blocks(
        """SELECT model, is_total, slice, sum(n)::BIGINT AS n, count(*) AS n_classes, round(sum(n * rec) / sum(n), 6) AS top1, round(avg(rec), 6) AS balanced_acc, round(min(rec), 6) AS worst_recall FROM c GROUP BY ALL""",
        S.PRED,
        """s AS (SELECT model, true AS is_total, 'all' AS slice, y, pred FROM pd UNION ALL SELECT model, false, source, y, pred FROM pd),
           c AS (SELECT model, is_total, slice, y, count(*) AS n, avg((y = pred)::INT) AS rec FROM s GROUP BY ALL)""",
    ),
)
def slice_metrics(spark, sf):
    d = metrics.slice_metrics(S.pred(spark, sf), ["model"], "source")
    return d.select("model", "is_total", "slice", "n", "n_classes", *r6("top1", "balanced_acc", "worst_recall"))


@query(
    "slice_confusions",
    with_blocks("SELECT model, source, y_class, pred_class, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model, source ORDER BY n DESC, y_class, pred_class) AS r FROM (SELECT model, source, y_class, pred_class, count(*) AS n FROM pd WHERE y <> pred GROUP BY ALL)) WHERE r <= 2", S.PRED),
)
def slice_confusions(spark, sf):
    d = metrics.slice_confusions(S.pred(spark, sf), ["model"], "source", 2)
    return d.select("model", "source", nm(spark, sf, "y", "y_class"), nm(spark, sf, "pred", "pred_class"), "n", *big("rank"))


@query(
    "bucket_accuracy",
    with_blocks("SELECT model, CASE WHEN n_chars < 300 THEN '<300' WHEN n_chars < 1000 THEN '300-1000' WHEN n_chars < 3000 THEN '1000-3000' ELSE '>=3000' END AS bucket, count(*) AS n, count(*) FILTER (y = pred) AS n_correct, round(avg((y = pred)::INT), 6) AS accuracy FROM pd GROUP BY ALL", S.PRED),
)
def bucket_accuracy(spark, sf):
    d = metrics.bucket_accuracy(S.pred(spark, sf), ["model"], "n_chars", (300, 1000, 3000))
    return d.select("model", "bucket", "n", "n_correct", *r6("accuracy"))


@query(
    "eval_split",
    with_blocks(
        rounded_sql(S.metrics_sql("pdx", "model", S.MINORITY), "model", "top1,balanced_acc,macro_f1,minority_acc", "n, 'doc' AS split_kind, true AS mismatch"),
        S.PRED,
        """gs AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
           tries AS (SELECT d.draw, source, n, row_number() OVER (PARTITION BY d.draw ORDER BY md5('42:' || d.draw || ':' || source), source) AS r FROM gs CROSS JOIN range(200) d(draw)),
           best AS (SELECT draw FROM (SELECT draw, sum(n) AS held FROM tries WHERE r <= 4 GROUP BY draw) ORDER BY abs(held::DOUBLE / (SELECT sum(n) FROM gs) - 0.2), draw LIMIT 1),
           pdx AS (SELECT * FROM pd WHERE source IN (SELECT source FROM tries JOIN best USING (draw) WHERE r <= 4))""",
    ),
)
def eval_split(spark, sf):
    from tallyforge.operators.split import group_holdout_groups

    held = group_holdout_groups(C.documents(spark, sf).select("source"), "source").select(F.col("grp").alias("source"), F.lit(True).alias("held"))
    p = S.pred(spark, sf).join(small(held, 4), "source", "left")
    d = metrics.eval_split(p, F.col("held"), ["model"], S.train_counts(spark, sf), S.dim(spark, sf).rows, fitted_on="strat", kind="doc", minority=S.MINORITY)
    return d.select("model", "n", "split_kind", "mismatch", *r6("top1", "balanced_acc", "macro_f1", "minority_acc"))


@query(
    "compare_predictions",
    with_blocks(
        """SELECT count(*) AS n, round(avg((a.pred = a.y)::INT), 6) AS acc_a, round(avg((b.pred = a.y)::INT), 6) AS acc_b, count(*) FILTER (a.pred <> b.pred) AS n_disagree,
             count(*) FILTER (a.pred = a.y AND b.pred <> a.y) AS n_only_a, count(*) FILTER (a.pred <> a.y AND b.pred = a.y) AS n_only_b
           FROM pd a JOIN pd b USING (item_id) WHERE a.model = 'lengths' AND b.model = 'vowels'""",
        S.PRED,
    ),
)
def compare_predictions(spark, sf):
    p = S.pred(spark, sf)
    d = ensemble.compare_predictions(p.where("model = 'lengths'"), p.where("model = 'vowels'"), "item_id")
    return d.select("n", *r6("acc_a", "acc_b"), "n_disagree", "n_only_a", "n_only_b")


@query(
    "rank_models",
    with_blocks(
        f"""SELECT model, n, round(top1, 6) AS top1, round(balanced_acc, 6) AS balanced_acc, rank() OVER (ORDER BY top1 DESC) AS rank,
             (SELECT max(c) <= 3 * min(c) FROM (SELECT count(*) AS c FROM pd WHERE model = 'lengths' GROUP BY y)) AS balanced_batch FROM ({S.metrics_sql('pd', 'model', counts='')})""",
        S.PRED,
    ),
)
def rank_models(spark, sf):
    d = ensemble.rank_models(S.pred(spark, sf))
    return d.select("model", "n", *r6("top1", "balanced_acc"), *big("rank"), "balanced_batch")


@query(
    "weakest_classes",
    with_blocks(
        """SELECT model, y_class AS class, count(*) AS n_true, round(avg((y = pred)::INT), 6) AS recall FROM pd
           WHERE model = (SELECT model FROM pd GROUP BY model ORDER BY avg((y = pred)::INT) DESC, model LIMIT 1) GROUP BY ALL ORDER BY recall, class LIMIT 3""",
        S.PRED,
    ),
)
def weakest_classes(spark, sf):
    p = S.pred(spark, sf)
    per = metrics.class_metrics(metrics.confusion(p, ["model"]), ["model"])
    d = ensemble.weakest_classes(per, ensemble.rank_models(p), 3)
    return d.select("model", nm(spark, sf, "label", "class"), "n_true", *r6("recall"))


@query(
    "auroc",
    with_blocks(
        """SELECT c.model, j.kind, count(DISTINCT c.item_id) AS n_pos, count(DISTINCT j.item) AS n_neg,
             round(avg(CASE WHEN round(c.p1, 9) > round(j.p1, 9) THEN 1.0::DOUBLE WHEN round(c.p1, 9) = round(j.p1, 9) THEN 0.5 ELSE 0.0 END), 6) AS auroc
           FROM pd c JOIN jp j ON j.model = c.model GROUP BY ALL""",
        S.PRED, S.JUNK,
    ),
)
def auroc(spark, sf):
    j = S.junk_pred(spark, sf).select("model", "kind", "p1", F.lit(False).alias("clean"))
    kinds = F.explode(F.array(F.lit("benchmark"), F.lit("conversations"))).alias("kind")
    c = S.pred(spark, sf).select("model", kinds, "p1", F.lit(True).alias("clean"))
    both = c.unionByName(j).withColumn("p1", F.round("p1", 9))
    d = metrics.auroc(both, "p1", F.col("clean"), ["model", "kind"])
    return d.select("model", "kind", "n_pos", "n_neg", *r6("auroc"))


@query(
    "confident_at",
    with_blocks("SELECT model, kind, count(*) AS n, round(avg(p1), 6) AS mean_conf, round(avg((p1 >= 0.5)::INT), 6) AS conf_0_5, round(avg((p1 >= 0.7)::INT), 6) AS conf_0_7, round(avg((p1 >= 0.9)::INT), 6) AS conf_0_9 FROM jp GROUP BY ALL", C.SPLIT, S.FIT, S.JUNK),
)
def confident_at(spark, sf):
    d = metrics.confident_at(S.junk_pred(spark, sf), ["model", "kind"])
    return d.select("model", "kind", "n", *r6("mean_conf", "conf_0_5", "conf_0_7", "conf_0_9"))


@query(
    "threshold_tradeoff",
    with_blocks(
        """SELECT g.*, w.worst_leak FROM (SELECT model, t AS threshold, round(avg((p1 >= t)::INT), 6) AS clean_kept, round(avg((y = pred)::INT) FILTER (p1 >= t), 6) AS kept_accuracy FROM pd CROSS JOIN ts GROUP BY ALL) g
           LEFT JOIN (SELECT model, t, max(leak) AS worst_leak FROM (SELECT model, kind, t, round(avg((p1 >= t)::INT), 6) AS leak FROM jp CROSS JOIN ts GROUP BY ALL) GROUP BY ALL) w ON w.model = g.model AND w.t = g.threshold""",
        S.PRED, S.JUNK, "ts AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95])::DOUBLE AS t)",
    ),
)
def threshold_tradeoff(spark, sf):
    d = metrics.threshold_tradeoff(S.pred(spark, sf), S.junk_pred(spark, sf), (0.5, 0.7, 0.8, 0.9, 0.95))
    return d.select("model", "threshold", *r6("clean_kept", "kept_accuracy", "worst_leak"))
