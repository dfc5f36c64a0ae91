import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyforge.llm import sharding

SCHEMA = "doc_id bigint, text string"


def check(spark, rows, shards=16, **options):
    got = sharding.shard_records(spark.createDataFrame(rows, SCHEMA), shards=shards, keep=["doc_id"], **options).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(size(t) for _, t in rows), max([size(t) for _, t in rows], default=0)
    sums = [sum(r.size for r in by[s]) for s in range(shards)]
    assert all(abs(x - total / shards) <= largest for x in sums), sums
    return got


def corpus():
    rng = np.random.default_rng(0)
    rows = [(i, "é" * int(rng.integers(0, 300))) for i in range(800)]
    return rows + [(1000 + i, "one text in a third of all rows") for i in range(500)]


@pytest.mark.parametrize("options", [{}, {"ranges": 4, "cell_rows": 20}, {"cell_rows": 7}, {"ranges": 1}])
def test_bytes_law(spark, options):
    got = check(spark, corpus(), **options)
    # equal texts lie next to each other: they fill whole shards and two parts at most
    hot = {r.shard for r in got if r.doc_id >= 1000}
    assert len(hot) <= len({r.shard for r in got}) and hot == set(range(min(hot), max(hot) + 1))


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (2, ""), (None, "x"), (3, "long " * 30000)], shards=3)
    check(spark, [])
    check(spark, [(i, "same") for i in range(100)], cell_rows=9)


def test_columns_and_plan(spark):
    d = spark.createDataFrame([(1, "a", "s", 7)], SCHEMA + ", shard string, size int")
    out = sharding.shard_records(d)
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))
