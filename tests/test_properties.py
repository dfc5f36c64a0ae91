"""Random inputs against brute force, and plan properties that matter at scale."""

import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, small
from tallyforge.functions.ranking import _hashed, hash_cutoffs, hash_rank, take_in_hash_order
from tallyforge.operators import clean, metrics, sample, split

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@few
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=4), goal=st.integers(0, 45), seed=st.integers(0, 99))
def test_any_goal_takes_the_hash_prefix(spark, sizes, goal, seed):
    rows = [(f"k{c}.{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    d = spark.createDataFrame(rows, "key string, c int")
    got = Counter(r.c for r in take_in_hash_order(d, "c", "key", lambda n: F.lit(goal), seed).where("taken").collect())
    assert got == Counter({c: min(goal, n) for c, n in enumerate(sizes) if goal})
    ranks = {r.key: r["rank"] for r in hash_rank(d, "c", "key", seed, digits=1).collect()}
    for c in range(len(sizes)):
        keys = sorted((k for k, x in rows if x == c), key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
        assert [ranks[k] for k in keys] == list(range(1, len(keys) + 1))


@few
@given(rows=st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["p", "q", "r", None]), st.booleans(), st.booleans()), min_size=1, max_size=25))
def test_ledger_adds_up_and_agrees_with_the_index(spark, rows):
    data = [(i, c, t, ok, cp) for i, (c, t, ok, cp) in enumerate(rows)]
    d = spark.createDataFrame(data, "key int, c string, t string, ok boolean, cp boolean").withColumn("g", F.lit("g"))
    m = clean.manifest(d, "key", "c", "g", "t", F.col("ok"), F.col("cp"))
    dim = Classes.of(spark, list("xyz"))
    ledger = {r.rule: r.n for r in clean.cleaning_ledger(m, dim).collect()}
    assert ledger == {r.rule: r.n for r in clean.cleaning_ledger(m).collect()}
    classes = {}
    for _, c, t, _, _ in data:
        classes.setdefault(t, set()).add(c)
    want, seen, kept = Counter(), set(), set()
    for key, c, t, ok, cp in data:
        if t is None or not ok:
            want["unreadable"] += 1
        elif cp:
            want["copy"] += 1
        elif len(classes[t]) > 1:
            want["cross_class"] += 1
        elif (t, c) in seen:
            want["within_dup"] += 1
        else:
            want["kept"] += 1
            seen.add((t, c))
            kept.add(key)
    assert {k: v for k, v in ledger.items() if v} == dict(want)
    assert {r.key for r in clean.clean_index(m, dim).collect()} == kept


def test_buckets_of_a_hot_class_stay_small(spark):
    d = spark.range(300_000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("c"))
    biggest = _hashed(d, "key", 42, 4).groupBy("c", "_b").count().agg(F.max("count")).first()[0]
    assert biggest < 20  # of 100,000 rows in the class


def test_marking_a_split_does_not_shuffle_the_rows(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("c"), F.lit("text").alias("text")).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    cuts = hash_cutoffs(d, "c", "key", lambda n: [split.val_quota(n)], rows=3).collect()
    stored = spark.createDataFrame(cuts, hash_cutoffs(d, "c", "key", lambda n: [split.val_quota(n)], rows=3).schema)
    marked = split.stratified_split(d, "c", "key", rows=3, cutoffs=stored)
    assert "Exchange hashpartitioning" not in plan(marked) and "BroadcastHashJoin" in plan(marked)
    # the passes that find the cut-offs read key and class only
    assert "text" not in plan(hash_cutoffs(d, "c", "key", lambda n: [split.val_quota(n)], rows=3)).split("FileScan")[1].split("Location")[0]


def test_group_draws_are_limited_before_the_exchange(spark):
    d = spark.range(1000).select((F.col("id") % 40).alias("g"))
    assert "WindowGroupLimit" in plan(split.group_holdout_groups(d, "g"))


def test_metrics_shuffle_cells_only(spark):
    d = spark.createDataFrame([("m", 0, [1.0, 0.0])], "model string, y int, scores array<double>")
    text = plan(metrics.compute_metrics(d, ["model"], spark.createDataFrame([("a", 0, 3), ("b", 1, 4)], "class string, label int, n int"), 2))
    exchanges = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("scores" not in x for x in exchanges) and "Window" not in text


def test_one_row_tables_need_no_join(spark):
    d = attach_row(spark.range(5), spark.range(3).agg(F.max("id").alias("m"), F.min("id").alias("lo")))
    assert "Join" not in plan(d) and {tuple(r) for r in d.collect()} == {(i, 2, 0) for i in range(5)}


def test_small_needs_a_known_bound(spark):
    hint = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert not hint(small(spark.range(3), None)) and not hint(small(spark.range(3), 10**9)) and hint(small(spark.range(3), 3))


@pytest.mark.parametrize("power, cap", [(0.5, 10.0), (1.0, 2.0)])
def test_cdf_covers_the_unit_interval(spark, power, cap):
    counts = spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate([("a", 7), ("b", 1000), ("c", 0), ("d", 33)])], "class string, label int, n bigint")
    rows = sample.class_cdf(sample.weight_table(counts, power, cap)).orderBy("class").collect()
    assert [r["class"] for r in rows] == ["a", "b", "d"] and rows[0].lo == 0.0 and rows[-1].hi == 1.0
    assert all(x.hi == y.lo for x, y in zip(rows, rows[1:]))
    u = spark.createDataFrame([(0.0,), (rows[0].hi,), (0.9999999999,)], "u double")
    assert [r["class"] for r in sample.range_draw(u, "u", sample.class_cdf(sample.weight_table(counts, power, cap))).orderBy("u").collect()] == ["a", "b", "d"]
