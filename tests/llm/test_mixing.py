from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string"
LEVELS = lambda: {"lang": F.col("lang"), "source": F.col("source")}


def fill(children, budget):
    """Brute force: deal by weight, again and again, to those not yet full."""
    got = {k: 0.0 for k in children}
    budget = min(budget, sum(s for s, w in children.values() if w > 0))
    while True:
        open_ = {k for k, (s, w) in children.items() if w > 0 and got[k] < s - 1e-9}
        left = budget - sum(got.values())
        if left < 1e-6 or not open_:
            return got
        total = sum(children[k][1] for k in open_)
        for k in open_:
            got[k] = min(children[k][0], got[k] + left * children[k][1] / total)


@pytest.mark.parametrize("budget", [0, 5, 37, 90, 400, 10_000])
def test_water_filling(spark, budget):
    children = {"a": (10, 1.0), "b": (100, 2.0), "c": (3, 5.0), "d": (100, 1.0), "e": (10, 1.0), "f": (50, 0.0), "g": (7, 0.3)}
    rows = [(k, None, s, w, budget) for k, (s, w) in children.items()]
    d = spark.createDataFrame(rows, "name string, up string, supply bigint, weight double, budget bigint")
    got = {r.name: r.budget for r in mixing.deal(d, ["up"]).collect()}
    want = fill(children, budget)
    assert all(abs(got[k] - want[k]) < 1 + 1e-6 and got[k] <= children[k][0] for k in children), (got, want)


def mixed(spark, rows, budget, weights=None, **options):
    d = spark.createDataFrame(rows, SCHEMA)
    weights = weights or {"lang": F.lit(1.0), "source": F.lit(1.0)}
    return mixing.mix(d, LEVELS(), weights, F.lit(budget), keep=["doc_id"], **options).collect()


def test_shortage_goes_to_siblings_first_and_prefixes_hold(spark):
    # de: one small and one large source; en: one source
    rows = [(i, "a b c d e", "de", "s1") for i in range(2)] + [(10 + i, "a b c d e", "de", "s2") for i in range(40)] + [(100 + i, "a b c d e", "en", "s3") for i in range(40)]
    got = mixed(spark, rows, 100, max_epochs=1)
    sums = defaultdict(int)
    for r in got:
        sums[r.source] += r.tokens * r.epochs
    # each language 50; s1 has 10 only, its sibling s2 takes the rest of the 25 + 15
    assert dict(sums) == {"s1": 10, "s2": 40, "s3": 50}
    # two epochs: a whole one and a prefix of another order
    got = mixed(spark, rows, 300, max_epochs=2)
    assert {r.epochs for r in got if r.source == "s2"} <= {0, 1, 2} and sum(r.tokens * r.epochs for r in got) in range(296, 312)
    assert mixed(spark, rows, 10**9, max_epochs=2) and all(r.epochs == 2 for r in mixed(spark, rows, 10**9, max_epochs=2))
    again = mixed(spark, rows[::-1], 300, max_epochs=2)
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_child_of_weight_zero_supplies_nothing(spark):
    rows = [(1, "w " * 100, "a", "x"), (2, "w " * 10, "a", "y"), (3, "w " * 100, "b", "z")]
    weights = {"lang": F.lit(1.0), "source": F.when(F.col("source") == "x", 0.0).otherwise(1.0)}
    got = {r.doc_id: r.epochs for r in mixed(spark, rows, 110, weights, max_epochs=1)}
    # a can spend 10 of its 55; b takes the rest of the budget
    assert got == {1: 0, 2: 1, 3: 1}
    finer = [(100 + i, "w", "b", "z") for i in range(100)] + rows[:2]
    got = mixed(spark, finer, 100, weights, max_epochs=1)
    assert sum(r.tokens * r.epochs for r in got) == 100 and sum(r.epochs for r in got if r.lang == "b") == 90
    # the whole family has no weight: everything goes to the other
    nothing = {"lang": F.when(F.col("lang") == "a", 0.0).otherwise(1.0), "source": F.lit(1.0)}
    assert sum(r.tokens * r.epochs for r in mixed(spark, finer, 100, nothing, max_epochs=1)) == 100


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "w w", "en", "s"), (3, "x y z", None, "s"), (3, "x y z", None, "s"), (4, "long " * 20000, "en", "s")]
    got = mixed(spark, rows, 10**7, max_epochs=3)
    assert len(got) == 6 and {r.doc_id: r.epochs for r in got} == {1: 0, 2: 0, None: 3, 3: 3, 4: 3}
    assert mixed(spark, rows, 0) and all(r.epochs == 0 for r in mixed(spark, rows, 0))
    assert mixed(spark, [], 100) == []


def test_repeating_keeps_the_columns(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 4, "x")], SCHEMA + ", tokens int, epochs string")
    out = mixing.repeat_rows(d, levels=LEVELS(), weights={"lang": F.lit(1), "source": F.lit(1)}, budget=F.lit(4), max_epochs=2)
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [tuple(d.first())] * 2
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
