import pytest
from pyspark.sql import functions as F

from tallyforge.functions import bounds
from tallyforge.functions.bounds import Classes
from tallyforge.operators import clean, codec, overlay, profile, sample


@pytest.fixture(scope="module")
def m(spark):
    rows = [
        ("a1", "x", "same", True, False), ("a2", "x", "same", True, False),  # within-class copy
        ("b1", "x", "both", True, False), ("b2", "y", "both", False, False),  # conflict with an unreadable row
        ("c1", "y", "cp", True, True), ("d1", "y", "solo", True, False), ("e1", "y", None, True, False),
    ]
    d = spark.createDataFrame(rows, "key string, class string, text string, good boolean, copied boolean")
    return clean.manifest(d.withColumn("g", F.lit("g")), "key", "class", "g", "text", F.col("good"), F.col("copied")).cache()


def test_rules_apply_in_order_and_conflicts_are_judged_on_raw_rows(m):
    got = {r.rule: r.n for r in clean.cleaning_ledger(m).collect()}
    assert got == {"unreadable": 2, "copy": 1, "cross_class": 1, "within_dup": 1, "kept": 2}


def test_clean_index_keeps_the_first_key_per_hash(spark, m):
    idx = clean.clean_index(m, Classes.of(spark, ["x", "y"])).collect()
    assert {r.key for r in idx} == {"a1", "d1"}
    assert {r.key: r.label for r in idx} == {"a1": 0, "d1": 1}


def test_unreadable_content_is_no_duplicate(m):
    assert m.where("key = 'e1'").first().md5 is None
    s = profile.dup_summary(m).first()
    assert (s.n_groups, s.n_redundant, s.n_cross_class, s.n_unique, s.n_copies) == (2, 2, 1, 4, 1)


def test_dup_members_of_a_hot_group(m, rows):
    assert rows(profile.dup_members(m)) == rows(profile.dup_members(m, hot_rows=1))


@pytest.mark.parametrize("sizes, want", [([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75), ([0, 0], 0.0)])
def test_gini(spark, sizes, want):
    d = spark.createDataFrame([(s,) for s in sizes], "n int")
    assert profile.gini(d).first().gini == pytest.approx(want)


def test_codes_round_trip_over_the_whole_universe(spark):
    codes = list(codec.CORPUS_CODES)
    assert len(codes) == 72
    d = codec.class_dim(spark.createDataFrame([(c,) for c in codes], "code int"))
    got = d.withColumn("back", codec.code_of(F.col("char"))).orderBy("code").collect()
    assert [r.back for r in got] == codes and [r.label for r in got] == list(range(72))
    assert got[0].char == "ก"
    named = d.select(codec.categorise(F.col("code").cast("bigint") - 0xA0 + 0x0E00).alias("c")).groupBy("c").count().collect()
    assert {r.c for r in named} == {"consonant", "vowel", "tone_mark", "digit"}


def test_categorise_fails_outside_the_ranges(spark):
    with pytest.raises(Exception, match="no category"):
        spark.range(1).select(codec.categorise(F.col("id"))).collect()


def test_file_names(spark):
    names = ["be_012sg_3_45.jpg", "Copy of BL_100tg_1_2.JPG", "be_12sg_3_45.jpg", "notes.txt"]
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", *codec.parse_name(F.col("n"))).collect()
    a, b, c, e = d
    assert (a.prefix, a.doc_id, a.subset, a.line, a.idx, a.group, a.parsed, a.is_copy) == ("be", 12, "sg", 3, 45, "be_012", True, False)
    assert (b.prefix, b.is_copy, b.parsed) == ("BL", True, True)
    assert not c.parsed and c.doc_id is None and c.group is None and not e.parsed


def test_label_from_the_nearest_folder(spark):
    chars = {"ก": "161", "ข": "162"}
    paths = {
        "161/page/x.png": "161", "161/162/x.png": "162", "misc/ข_scan/x.png": "162", "misc/162.png": "162",
        "misc/x.png": None, "999/161x/y.png": "161", "class_1615/x.png": "161",
    }
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    got = d.select("p", codec.label_from_path(F.col("p"), range(161, 163), chars).alias("l")).collect()
    assert {r.p: r.l for r in got} == paths


def test_source_names(spark):
    d = spark.createDataFrame([("Noto-Bold[wght].ttf",), ("plain.ttf",), ("",)], "n string")
    assert [r.f for r in d.select(codec.family_of(F.col("n")).alias("f")).collect()] == ["Noto", "plain", ""]
    d = spark.createDataFrame([("Set2_M1_P-0059_17.JPG",)], "n string")
    assert d.select(codec.writer_key(F.col("n")).alias("w")).first().w == "Set2_M1_P-0059"


def test_alias_lookup(spark):
    al = spark.createDataFrame([("ko-kai", "k"), ("digit one", "1")], "alias string, class string")
    d = spark.createDataFrame([("  THAI Character KO__KAI",), ("Digit  One",), ("x",)], "n string")
    got = {r.n.strip(): r["class"] for r in codec.normalise_name(d, "n", al, 2).collect()}
    assert got == {"THAI Character KO__KAI": "k", "Digit  One": "1", "x": None}


def test_external_names(spark):
    d = spark.createDataFrame([("ko-161-a-12.png",), ("ko-161-a-12 - Copy.png",), ("ko-x-a.png",), ("ko-161.png",), ("a-162-P-0007_3.jpg",)], "n string")
    got = {r.n: (r.code, r.writer_id) for r in codec.parse_external_names(d, "n").collect()}
    assert got == {"ko-161-a-12.png": (161, "12"), "ko-161-a-12 - Copy.png": (161, "12"), "a-162-P-0007_3.jpg": (162, "P-0007")}


def test_unknown_classes_get_labels_after_the_known(spark):
    d = spark.createDataFrame([("b",), ("z",), ("q",), ("b",)], "c string")
    got = {r.c: (r.in_universe, r.label) for r in codec.universe_partition(d, "c", Classes.of(spark, ["a", "b"])).collect()}
    assert got == {"b": (True, 1), "q": (False, 2), "z": (False, 3)}


def test_a_universe_beyond_the_bound_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bounds, "SMALL_ROWS", 2)
    d = spark.createDataFrame([(c,) for c in "abc"], "c string")
    big = Classes.from_column(d, "c")
    assert big.names is None and big.rows is None and big.df.count() == 3
    with pytest.raises(ValueError):
        big.require_names()
    hint = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert not hint(big.side) and hint(bounds.small(d, 2)) and not hint(bounds.small(d, 3))
    # labels are the same dense ranks, and unknown classes follow them
    assert {r["class"]: r.label for r in big.df.collect()} == {"a": 0, "b": 1, "c": 2}
    more = spark.createDataFrame([(c,) for c in ("b", "z", "q", None)], "c string")
    got = {r.c: (r.in_universe, r.label) for r in codec.universe_partition(more, "c", big).collect()}
    assert got == {"b": (True, 1), "q": (False, 3), "z": (False, 4), None: (False, None)}
    many = spark.range(1000).selectExpr("cast(id as string) as name")
    ranked = {r.name: r.label for r in bounds.dense_labels(many, "name").collect()}
    assert ranked == {n: i for i, n in enumerate(sorted(str(i) for i in range(1000)))}


def test_reconcile(spark):
    man = spark.createDataFrame([("1", "a", "h1"), ("2", "b", "h2"), ("3", "c", "h3"), ("4", "d", "h4")], "key string, name string, md5 string")
    files = spark.createDataFrame(
        [("p9", "a", "h1"), ("p1", "b", "x"), ("p2", "b", "h2"), ("p4", "c", "y"), ("p3", "c", "z")], "path string, name string, md5 string"
    )
    got = {r.key: (r.path, r.status, r.n_candidates) for r in clean.reconcile_manifest(man, files).collect()}
    assert got == {"1": ("p9", "verified", 1), "2": ("p2", "verified", 2), "3": ("p3", "mismatch", 2), "4": (None, "missing", 0)}


def test_diff_and_overlay(spark):
    a = spark.createDataFrame([(1, "f1", "x"), (2, "f2", "x"), (3, "f3", "y"), (4, "f4", "y"), (5, "f4", "x"), (6, "f6", "x")], "key int, name string, cls string")
    b = spark.createDataFrame([("f1", "x"), ("f2", "y"), ("f4", "x"), ("f6", "x"), ("f6", "y")], "name string, cls string")
    d = overlay.diff_labels(a, b, "key", "name", "cls")
    assert {r.name: r.action for r in d.collect()} == {"f1": "same", "f2": "move", "f3": "drop", "f4": "ambiguous", "f6": "ambiguous"}
    out = overlay.overlay_changes(a, overlay.change_list(d), "key", "cls", Classes.of(spark, ["x", "y"])).collect()
    assert {r.key: (r.cls, r.label) for r in out} == {1: ("x", 0), 2: ("y", 1), 4: ("y", 1), 5: ("x", 0), 6: ("x", 0)}


@pytest.fixture(scope="module")
def cand(spark):
    rows = [(1, "a", "b", 0.9), (2, "a", "b", 0.8), (3, "b", "a", 0.95), (4, "a", "b", 0.5)]
    return spark.createDataFrame(rows, "key int, y_class string, pred_class string, p_pred double").cache()


def test_first_action_wins(spark, cand):
    rev = spark.createDataFrame([(1, " Drop "), (3, "keep")], "key int, verdict string")
    dim = Classes.of(spark, ["a", "b"])
    got = overlay.plan_fixes(cand, dim, rev, relabel=["a>b"], drop=["a > b", "b>a"]).collect()
    assert {r.key: r.action for r in got} == {1: "drop", 2: "relabel", 3: "drop"}
    corpus = spark.createDataFrame([(i, "a" if i != 3 else "b") for i in range(1, 6)], "key int, cls string")
    acts = overlay.plan_fixes(cand, dim, rev, relabel=["a>b"])
    assert {r.key: r.cls for r in overlay.apply_fixes(corpus, acts, "key", "cls", dim).collect()} == {2: "b", 3: "b", 4: "a", 5: "a"}


def test_one_action_per_key_and_changes_never_multiply_rows(spark):
    rows = [(1, "a", "b", 0.9), (1, "a", "c", 0.8), (2, "a", "c", 0.9)]
    twice = spark.createDataFrame(rows, "key int, y_class string, pred_class string, p_pred double")
    dim = Classes.of(spark, ["a", "b", "c"])
    got = overlay.plan_fixes(twice, dim, relabel=["a>c", "a>b"]).collect()
    assert {(r.key, r.to_class) for r in got} == {(1, "c"), (2, "c")} and len(got) == 2
    rev = spark.createDataFrame([(1, "relabel", 1), (1, "drop", 2)], "key int, verdict string, pos int")
    assert [(r.key, r.action) for r in overlay.plan_fixes(twice, dim, rev).collect()] == [(1, "relabel")]
    corpus = spark.createDataFrame([(1, "a"), (2, "a")], "key int, cls string")
    assert overlay.apply_fixes(corpus, overlay.plan_fixes(twice, dim, relabel=["a>c", "a>b"]), "key", "cls", dim).count() == 2
    listed = spark.createDataFrame([(1, "b", "move"), (1, "b", "move")], "key int, new_class string, action string")
    assert overlay.overlay_changes(corpus, listed, "key", "cls", dim).count() == 2
    with pytest.raises(Exception, match="several changes of 1"):
        overlay.overlay_changes(corpus, listed.unionByName(spark.createDataFrame([(1, "c", "move")], listed.schema)), "key", "cls", dim).collect()


def test_fix_plans_reject_what_has_no_candidate(spark, cand):
    dim = Classes.of(spark, ["a", "b", "c"])
    with pytest.raises(Exception, match="no candidate for a>c"):
        overlay.plan_fixes(cand, dim, relabel=["a>c"]).collect()
    with pytest.raises(Exception, match="no candidate for 4"):
        overlay.plan_fixes(cand, dim, spark.createDataFrame([(4, "drop")], "key int, verdict string")).collect()
    for bad in (["ab"], ["a>q"]):
        with pytest.raises(ValueError):
            overlay.plan_fixes(cand, dim, relabel=bad)


def test_weights_are_capped(spark):
    d = spark.createDataFrame([("a",)] * 100 + [("b",)], "c string")
    w = {r.c: r.weight for r in sample.sample_weights(d, Classes.of(spark, ["a", "b"]), "c", 1.0, cap=3).distinct().collect()}
    assert w["b"] == 3.0 and w["a"] == pytest.approx(101 / 2 / 100)


def test_fill_knobs(spark):
    dim = Classes.of(spark, ["few", "many", "none"])
    extra = spark.createDataFrame([(f"{c}{i}", c) for c in ("few", "many", "none") for i in range(30)], "key string, c string")
    real = spark.createDataFrame([("few", 0, 5), ("many", 1, 90), ("none", 2, 0)], "class string, label int, n bigint")
    got = lambda **kw: {r.c: r["count"] for r in sample.fill_extra(extra, real, "c", "key", rows=dim.rows, **kw).groupBy("c").count().collect()}
    assert got(fill_to=20) == {"few": 15, "none": 20}
    assert got(fill_to=100, max_real=50) == {"few": 30, "none": 30}
    assert got(fill_to=100, max_per_class=7) == {"few": 7, "many": 7, "none": 7}
    assert got(mode="all") == {"few": 30, "many": 30, "none": 30}


def test_resample_is_whole_and_repeatable(spark, rows):
    d = spark.createDataFrame([(f"a{i}", "a") for i in range(90)] + [(f"b{i}", "b") for i in range(10)], "key string, c string")
    dim = Classes.of(spark, ["a", "b"])
    one = sample.weighted_resample(d, dim, "c", "key", 500, 1.0)
    assert one.count() == 500
    assert rows(one.select("draw", "key")) == rows(sample.weighted_resample(d.repartition(5), dim, "c", "key", 500, 1.0).select("draw", "key"))
    share = one.where("c = 'b'").count() / 500
    assert 0.4 < share < 0.6


def test_merge_keeps_all_rows_and_columns(spark):
    a = spark.createDataFrame([(i, "x") for i in range(5)], "key int, p string")
    b = spark.createDataFrame([(i, 1.0) for i in range(7)], "key int, q double")
    d = overlay.merge_sources([a, b], ["a", "b"], "key")
    assert d.count() == 12 and set(d.columns) == {"key", "p", "q", "origin"} and d.select("key").distinct().count() == 12


def test_entity_without_a_known_class_is_flagged(spark):
    d = spark.createDataFrame([("e", "a", 1), ("f", "zz", 1)], "e string, c string, v int")
    got = {r.entity: (r.n_ok, r.n_bad, r.flagged) for r in profile.coverage_matrix(d, "e", "c", F.col("v") > 0, Classes.of(spark, ["a", "b"]), max_missing=1).collect()}
    assert got == {"e": (1, 1, False), "f": (0, 2, True)}


def test_audit_counts_rows_without_content_apart(spark):
    a = spark.createDataFrame([(None, "x"), ("h", "x"), ("h", "y")], "h string, c string")
    b = spark.createDataFrame([(None, "y"), (None, "y"), ("h", "y"), ("h", "z")], "h string, c string")
    r = profile.audit_overlap(a, b, "h", "c").first()
    assert (r.n_a, r.n_b, r.n_shared, r.n_new, r.n_moved, r.n_dropped, r.null_a, r.null_b) == (3, 4, 2, 0, 1, 0, 1, 2)


def test_audit_of_two_versions(spark):
    a = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h2", "x"), ("h3", "y")], "h string, c string")
    b = spark.createDataFrame([("h1", "y"), ("h2", "x"), ("h4", "y")], "h string, c string")
    r = profile.audit_overlap(a, b, "h", "c").first()
    assert (r.n_a, r.n_b, r.n_shared, r.n_new, r.n_moved, r.n_dropped) == (4, 3, 2, 1, 1, 1)
