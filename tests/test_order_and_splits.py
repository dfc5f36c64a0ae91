import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import skew
from tallyforge.functions.ranking import hash_rank, take_in_hash_order
from tallyforge.operators import split

SIZES = {"hot": 400, "mid": 57, "five": 5, "four": 4, "two": 2, "one": 1}


def items():
    return [(f"{c}-{i}", c, i % 7) for c, n in SIZES.items() for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(items(), "key string, cls string, grp int").cache()


def ordered(cls, seed=42):
    keys = [k for k, c, _ in items() if c == cls]
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def test_take_is_the_prefix_of_the_hash_order(df):
    # few digits put many rows of the hot class into one bucket
    for goal in (1, 3, 200, 1000):
        got = take_in_hash_order(df, "cls", "key", lambda n: F.lit(goal)).where("taken").collect()
        for c in SIZES:
            assert {r.key for r in got if r.cls == c} == set(ordered(c)[:goal])


def test_take_with_weights_stops_after_the_goal_is_reached(spark):
    w = [(f"g{i}", "a", (i * 7) % 11 + 1) for i in range(60)]
    d = spark.createDataFrame(w, "key string, cls string, n int")
    total = sum(x[2] for x in w)
    got = {r.key for r in take_in_hash_order(d, "cls", "key", lambda t: 0.3 * t, weight="n").where("taken").collect()}
    want, run = set(), 0
    for k, _, n in sorted(w, key=lambda x: (hashlib.md5(f"42:{x[0]}".encode()).hexdigest(), x[0])):
        if run >= 0.3 * total:
            break
        want.add(k)
        run += n
    assert got == want


def test_goal_zero_takes_nothing(df):
    assert take_in_hash_order(df, "cls", "key", lambda n: F.lit(0)).where("taken").count() == 0


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank_is_exact(df, digits):
    got = {r.key: r["rank"] for r in hash_rank(df, "cls", "key", digits=digits).collect()}
    for c in SIZES:
        assert [got[k] for k in ordered(c)] == list(range(1, SIZES[c] + 1))


def test_stratified_split_sizes(df):
    got = split.stratified_split(df, "cls", "key").groupBy("cls").agg(F.count_if(F.col("split") == "val").alias("v")).collect()
    # half-even: 0.2 * 57 = 11.4 -> 11
    assert {r.cls: r.v for r in got} == {"hot": 80, "mid": 11, "five": 1, "four": 1, "two": 1, "one": 0}


def test_split_does_not_depend_on_partitioning(df, rows):
    a = split.stratified_split(df.repartition(1), "cls", "key").select("key", "split")
    b = split.stratified_split(df.repartition(13, "grp"), "cls", "key").select("key", "split")
    assert rows(a) == rows(b)
    c = split.stratified_split(df, "cls", "key", seed=7).select("key", "split")
    assert rows(a) != rows(c)


def test_both_folds_have_the_same_sizes(df):
    for fn in (split.kfold, split.range_folds):
        got = {(r.cls, r.fold): r["count"] for r in fn(df, "cls", "key", 5).groupBy("cls", "fold").count().collect()}
        for c, n in SIZES.items():
            assert [got.get((c, f), 0) for f in range(5)] == [n // 5 + (f < n % 5) for f in range(5)]


def test_group_holdout_keeps_groups_whole_and_is_near_the_target(df):
    d = split.group_holdout_split(df, "grp", k=2)
    sides = d.groupBy("grp").agg(F.count_distinct("doc_split").alias("n")).where("n > 1")
    assert sides.count() == 0
    share = d.agg(F.avg((F.col("doc_split") == "val").cast("int"))).first()[0]
    assert 0.15 < share < 0.35


def test_group_fraction_holdout_takes_whole_groups(df):
    got = split.group_fraction_holdout(df, "cls", "grp", 0.15).where("cls = 'hot'").collect()
    held = sum(r.n for r in got if r.held)
    assert held >= 60 and held - max(r.n for r in got if r.held) < 60


def test_overlap_check_sees_a_leak(spark):
    d = spark.createDataFrame([(1, "train"), (1, "val"), (2, "train")], "key int, split string")
    assert split.split_overlap_check(d, "key", ["split"]).first().n_both == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_groups_are_split_without_changing_the_join(spark, rows, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 9}") for i in range(200)], "id int, k string")
    groups = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k3'")
    plain = left.join(groups, ["k"], how)
    salted = skew.join_keyed(left, groups, ["k"], "id", how, hot_rows=10)
    assert sorted(plain.columns) == sorted(salted.columns)
    assert rows(plain.select(sorted(plain.columns))) == rows(salted.select(sorted(plain.columns)))


def test_a_fix_plan_reads_the_scores_once(spark, sf_dir="/root/testdata/sf0.001"):
    """the plan stands on the settled candidates, not on the scores they are found in."""
    from tallyforge.plans import q_errors

    files = q_errors.plan_fixes(spark, sf_dir).inputFiles()
    assert any("/candidates-" in f for f in files) and not any("/oof-" in f for f in files)
