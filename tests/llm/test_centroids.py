import hashlib
import math

import numpy as np
import pytest

from tallyforge.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(kept, key=name)[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (o, _) in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    total = sum(d for _, d in own)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, sum(y for x, y in own if x == c), total, sha[c]) for (i, _), (c, d) in zip(kept, own, strict=True)), key=repr)


def got(spark, rows, schema=SCHEMA):
    out = centroids.with_inertia(*centroids.cluster(spark.createDataFrame(rows, schema)))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300)
    bad = [float("nan"), float("inf"), -float("inf"), None]
    rows += [(900 + i, [*rows[i][1][:-1], x]) for i, x in enumerate(bad)]
    rows += [(910, None), (911, []), (912, rows[0][1][:63]), (913, [*rows[0][1], 0.5])]
    # one vector a third of all rows, repeated rows, NULL ids, large and negative components
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[3]] * 4 + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, [1000.25] * 64), (2001, [-0.001] * 64), (2002, [0.0] * 64)]
    assert got(spark, rows) == brute(rows)


def test_ties_and_few_vectors(spark):
    # two equal first centroids: the smaller number takes the vectors and the other stays empty
    same = [(4, [0.25] * 64)] * 9 + [(5, [0.5] * 64)] * 9
    assert got(spark, same) == brute(same)
    few = vectors(5)
    assert got(spark, few) == brute(few) and all(r[2] == 0 for r in got(spark, few))
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_clashing_columns_and_doubles(spark):
    rows = [(i, v, i, "x") for i, v in vectors(40)]
    wide = got(spark, rows, "vec_id bigint, embedding array<double>, cluster int, codes string")
    assert wide == brute([r[:2] for r in rows])


def test_lookup_tables_give_the_distances():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-50, 50, (70, 8)), rng.integers(-50, 50, (5, 8))
    assert np.array_equal(centroids.distances(x, c), ((x[:, None] - c[None]) ** 2).sum(axis=2))


def test_components_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="exceed 64 bits"):
        got(spark, [*vectors(20), (99, [1e9] * 64)])


def test_partitioning_does_not_matter(spark):
    rows = vectors(200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (centroids.with_inertia(*centroids.cluster(d)).collect() for d in (df.coalesce(1), df.repartition(23)))
    assert sorted(one) == sorted(many)
