import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.functions.vectors import first_max, rank_of, softmax_of
from tallyforge.operators import ensemble, errors, metrics, noise, sample, score, stress, triage


def one_hot(label, n=5):
    return [1.0 if i == label else 0.0 for i in range(n)]


@pytest.fixture(scope="module")
def seven(spark):
    y, p = [0, 0, 1, 1, 2, 3, 4], [0, 0, 1, 0, 2, 3, 0]
    rows = [("m", i, a, one_hot(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, item_id int, y int, scores array<double>").cache()


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(str(i), i, n) for i, n in enumerate([100, 100, 10, 10, 10])], "class string, label int, n bigint")


def test_metrics_of_the_hand_example(seven, counts):
    r = metrics.compute_metrics(seven, ["model"], counts, 5).first()
    assert r.top1 == pytest.approx(5 / 7) and r.topk == 1.0
    assert r.balanced_acc == pytest.approx((1 + 0.5 + 1 + 1 + 0) / 5)
    assert r.minority_acc == pytest.approx(2 / 3) and r.minority_macro == pytest.approx(2 / 3)
    f1 = [2 * 2 / (2 + 4), 2 * 1 / (2 + 1), 1.0, 1.0, 0.0]
    assert r.macro_f1 == pytest.approx(sum(f1) / 5) and r.n_classes_present == 5


def test_no_minority_class_means_null(seven, counts):
    r = metrics.compute_metrics(seven, ["model"], counts, 5, minority=5).first()
    assert r.minority_acc is None and r.minority_macro is None


def test_absent_classes_do_not_enter_the_means(seven, counts):
    r = metrics.compute_metrics(seven.where("y <= 1"), ["model"], counts, 5).first()
    assert r.n_classes_present == 2 and r.balanced_acc == pytest.approx(0.75)


def test_ties_go_to_the_lowest_label(spark):
    d = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "v array<double>")
    r = d.select(first_max(F.col("v")).alias("a"), *[rank_of(F.col("v"), F.lit(i)).alias(f"r{i}") for i in range(4)]).first()
    assert tuple(r) == (1, 4, 1, 2, 3)


def test_softmax_is_stable(spark):
    d = spark.createDataFrame([([1000.0, 1001.0],)], "v array<double>")
    p = d.select(softmax_of(F.col("v")).alias("p")).first().p
    assert p[1] == pytest.approx(1 / (1 + math.exp(-1))) and sum(p) == pytest.approx(1)


def test_tau_zero_changes_nothing_and_the_clip_comes_after_the_total(spark, seven, counts):
    lp = sample.log_prior(counts.withColumn("n", F.when(F.col("label") == 4, 0).otherwise(F.col("n"))))
    assert lp.where("label = 4").first().log_prior == pytest.approx(math.log(1 / 220))
    same = score.logit_adjust(seven, lp, 0).orderBy("item_id").collect()
    assert [r.scores for r in same] == [r.scores for r in seven.orderBy("item_id").collect()]


def test_first_best_tau_wins(spark):
    d = spark.createDataFrame([("m", 0.0, 0.5), ("m", 0.25, 0.7), ("m", 0.5, 0.7)], "model string, tau double, balanced_acc double")
    assert metrics.tau_best(d, ["model"]).first().tau == 0.25


def test_auroc_with_ties_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.randint(0, 12) / 12, rnd.random() < 0.3) for _ in range(300)] + [("b", 0.5, True)]
    d = spark.createDataFrame(rows, "g string, s double, pos boolean")
    got = {r.g: r.auroc for r in metrics.auroc(d, "s", F.col("pos"), ["g"]).collect()}
    pos = [s for g, s, p in rows if g == "a" and p]
    neg = [s for g, s, p in rows if g == "a" and not p]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_scorer_against_plain_python(spark):
    train = [("a", "bb ccc"), ("a", "b ccc"), ("b", "dddd eeee f")]
    test = [(1, "b zzzz"), (2, "12 !"), (3, "ddd ccc dddd"), (4, "bb ccc " * 500), (5, None)]
    t = spark.createDataFrame([(0 if c == "a" else 1, x) for c, x in train], "label int, text string")
    v = spark.createDataFrame(test, "item_id int, text string")
    words = score.words_of(t, "text", "label")
    m = score.nb_fit(score.tokens_of(words, models=["lengths"]), 2)
    q = score.nb_score(score.tokens_of(score.words_of(v, "text", "item_id"), models=["lengths"]), m, ["item_id"])
    assert not any(x in q._jdf.queryExecution().toString() for x in ("Exchange", "Generate", "Join"))
    n = {c: Counter(len(w) for k, x in train if k == c for w in x.split()) for c in "ab"}
    vocab = set(n["a"]) | set(n["b"])
    milli = lambda x: round(math.log(x) * 1e6)
    got = {r.item_id: (r.scores, r.known) for r in q.collect()}
    for i, text in test:
        toks = [len(w) for w in (text or "").split() if w.isalpha() and len(w) in vocab]
        for j, c in enumerate("ab"):
            lp = sum(milli((n[c][k] + 1) / (sum(n[c].values()) + len(vocab))) for k in toks)
            assert got[i][0][j] == pytest.approx((milli((2, 1)[j] / 3) + lp) / 1e6, abs=1e-9)
        assert got[i][1] == len(toks)


def test_out_of_fold_models_do_not_see_their_fold(spark):
    d = spark.createDataFrame([(0, 0, "aa"), (1, 0, "bbb"), (0, 1, "aa"), (1, 1, "bbb"), (1, 2, "zzzzzz")], "label int, fold int, text string")
    m = score.nb_fit(score.tokens_of(score.words_of(d, "text", "label", "fold"), models=["lengths"]), 2, 3)
    assert {(f, int(t)) for (_, f), (names, _) in m.tables.items() for t in names} == {(0, 2), (0, 3), (0, 6), (1, 2), (1, 3), (1, 6), (2, 2), (2, 3)}


def test_members_must_agree_on_the_label(spark):
    d = spark.createDataFrame([("m", 1, 0, [1.0, 0.0]), ("k", 1, 1, [0.0, 1.0])], "model string, item_id int, y int, scores array<double>")
    with pytest.raises(Exception, match="disagree"):
        ensemble.ensemble(d, ["item_id"], "soft", 2).collect()


def views(spark, rows):
    return spark.createDataFrame([(i, a, p, 0, c) for i, a, p, c in rows], "item int, angle int, pred int, y int, p1 double")


def test_guarded_search(spark):
    v = views(spark, [
        (1, 0, 0, 0.90), (1, 15, 1, 0.99),  # sure already
        (2, 0, 0, 0.50), (2, 15, 1, 0.80), (2, 30, 2, 0.79),  # not more than the margin
        (3, 0, 0, 0.50), (3, 15, 1, 0.85), (3, 30, 2, 0.95), (3, 45, 3, 0.95),  # earliest of the best
    ])
    got = {r.item: (r.searched, r.angle, r.pred) for r in ensemble.guarded_view_search(v, ["item"], "angle").collect()}
    assert got == {1: (False, 0, 0), 2: (True, 0, 0), 3: (True, 30, 2)}
    best = {r.item: r.angle for r in ensemble.best_of_views(v.unionByName(views(spark, [(4, 0, 5, 0.7), (4, 15, 6, 0.7)])), ["item"], "angle").collect()}
    assert best == {1: 15, 2: 15, 3: 30, 4: 0}


def test_view_probe_counts_neighbouring_views(spark):
    v = views(spark, [(i, 0, 0, 0.5) for i in range(4)] + [(0, 30, 0, 0.9), (1, 30, 0, 0.9), (2, 45, 0, 0.9), (3, 90, 0, 0.9)]).withColumn("b", F.lit("x"))
    r = triage.view_probe(v, ["item"], ["b"], "angle").first()
    assert r.modal_view == 30 and r.modal_share == pytest.approx(0.75) and r.lift == pytest.approx(0.4) and r.share_unsure == 1.0


def test_verdict_rules(spark):
    d = spark.createDataFrame([(10.0, 0.5, 40.0, 0.2)], "median_height double, share_dark_border double, median_levels double, median_ink_frac double")
    p = spark.createDataFrame([("m", 0.2, 0.7, 0.6)], "model string, lift double, modal_share double, share_unsure double")
    got = [r.finding for r in triage.verdict(d, p).orderBy("step").collect()]
    assert got == ["rotated", "very_low_resolution", "dark_border", "greyscale", "thin_strokes", "unconfident"]


def test_error_tables(seven, counts):
    cells = metrics.confusion(score.predict(seven), ["model"])
    top = errors.confused_directed(cells, ["model"], counts, 5, 1).first()
    # one row each for 1 -> 0 (50 %) and 4 -> 0 (100 %)
    assert (top.y, top.pred, top.n, top.pct) == (4, 0, 1, 100.0)
    worst = errors.worst_classes(cells, ["model"], counts, 5, 2).orderBy("rank").collect()
    assert [r.label for r in worst] == [4, 1] and worst[0].top[0].pred == 0
    sym = errors.confused_symmetric(cells, ["model"], 5).orderBy("rank").collect()
    assert [(r.a, r.b, r.total, r.b_to_a) for r in sym] == [(0, 1, 1, 1), (0, 4, 1, 1)]
    blind = errors.per_class_report(cells.where("y <> 4"), ["model"], counts, 5).where("blind").collect()
    assert [r.label for r in blind] == [4] and blind[0].recall is None


def test_noise_rows_and_suggestions(spark):
    rows = [(i, 0, 1, 0.9, 0.05) for i in range(5)] + [(9, 0, 2, 0.75, 0.1), (10, 0, 0, 0.9, 0.9), (11, 0, 1, 0.6, 0.3)]
    d = spark.createDataFrame(rows, "item_id int, y int, pred int, p1 double, p_true double")
    pairs = {(r.y, r.pred): (r.n, r.suggestion) for r in noise.noise_pairs(noise.noise_candidates(d)).collect()}
    assert pairs == {(0, 1): (5, "relabel"), (0, 2): (1, "review")}


def test_crossings_follow_harshness(spark):
    rows = [("m", "clean", 0.0, 1.0), ("m", "jpeg", 50.0, 0.95), ("m", "jpeg", 20.0, 0.8), ("m", "jpeg", 5.0, 0.4),
            ("m", "stroke_extreme", 3.0, 0.85), ("m", "stroke_extreme", -1.0, 0.3), ("m", "aspect_stretch", 0.9, 0.95), ("m", "aspect_stretch", 2.0, 0.6)]
    d = spark.createDataFrame(rows, "model string, condition string, severity double, top1 double")
    got = {r.condition: (r.below_90, r.below_50) for r in stress.crossing_points(stress.retention(d)).collect()}
    assert got == {"jpeg": (20.0, 5.0), "stroke_extreme": (3.0, -1.0), "aspect_stretch": (2.0, None)}


def test_identity_map_ties_and_silent_failures(spark):
    rows = [("m", "t", 0, 2, 0.9), ("m", "t", 0, 1, 0.9), ("m", "t", 3, 1, 0.9), ("k", "t", 3, 1, 0.95)]
    d = spark.createDataFrame(rows, "model string, condition string, y int, pred int, p1 double")
    m = stress.identity_map(d)
    assert m.where("y = 0").first().maps_to == 1
    assert [(r.y, r.maps_to, r.n_models) for r in stress.silent_failures(m).collect()] == [(3, 1, 2)]


def test_rejected_items_are_counted_not_scored(spark):
    rows = [("m", "c", 1.0, 0, 0, 1, 3), ("m", "c", 1.0, 0, 1, 2, 0)]
    d = spark.createDataFrame(rows, "model string, condition string, severity double, y int, pred int, rank_true int, known int")
    r = stress.sweep_table(d).first()
    assert (r.n, r.n_rejected, r.top1) == (1, 1, 1.0)


def test_python_model_hook(spark, seven):
    def make():
        return lambda pdf: pdf[["item_id"]].assign(best=[max(s) for s in pdf["scores"]])

    got = score.batch_score(seven.select("item_id", "scores"), make, "item_id int, best double").collect()
    assert len(got) == 7 and all(r.best == 1.0 for r in got)


def test_label_resolution(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "l string")
    r = triage.resolve_labels(d, "l", Classes.of(spark, ["a", "b", "c"])).first()
    assert tuple(r) == (4, 3, 1, 2, 1, 1, 1.5, 2)


def test_equal_recalls_give_equal_balanced_accuracy_whatever_their_order(spark):
    """F1: the first tau wins a tie, also where 0.1 + 0.2 + 0.3 depends on the order of addition."""
    orders = [(1, 2, 3), (3, 2, 1), (2, 3, 1), (3, 1, 2)]
    rows = [(t / 4, label, 10, tp, 10, tp, tp / 10, tp / 10) for t, o in enumerate(orders) for label, tp in enumerate(o)]
    per = spark.createDataFrame(rows, "tau double, label int, n_true long, tp long, n_pred long, hits long, recall double, f1 double").coalesce(1)
    got = metrics.summarise(per, ["tau"])
    assert len({r.balanced_acc for r in got.collect()}) == 1
    assert metrics.tau_best(got.withColumn("model", F.lit("m")), ["model"]).first().tau == 0.0
