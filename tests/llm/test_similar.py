import numpy as np
import pytest

from tallyforge.llm import similar

SCHEMA = "doc_id bigint, text string"


def jaccard(a, b):
    one, two = (set(similar.shingle_set((t or "").encode()).tolist()) for t in (a, b))
    return len(one & two) / len(one | two) if one | two else 1.0


def brute(rows, least=similar.SIMILARITY):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups.values()


def corpus():
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(2000)]
    out = []
    for k in range(80):
        base = list(rng.choice(vocab, rng.integers(40, 300)))
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            near = list(base)
            for _ in range(rng.integers(1, 2 + len(base) // (60 if k % 2 else 8))):
                near[rng.integers(0, len(near))] = "changed"
            out.append(" ".join(near))
    rows = list(enumerate(out))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one"), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (None, "alone here now then and later")]
    return rows


@pytest.mark.parametrize("part", [similar.PART, 3])
def test_groups_equal_brute_force(spark, part):
    rows = corpus()
    got = similar.similar_groups(spark.createDataFrame(rows, SCHEMA), part=part).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.root, []).append(r.doc_id)
    found = {tuple(sorted(map(repr, g))) for g in by.values()}
    want = {tuple(sorted(repr(rows[i][0]) for i in g)) for g in brute(rows)}
    # recall at the very threshold is below one; all groups of clearly similar texts are found, and no other
    clear = {tuple(sorted(repr(rows[i][0]) for i in g)) for g in brute(rows, 0.85)}
    assert len(want & found) >= 0.97 * len(want)
    owner = {x: w for w in want for x in w if x != "None"}
    assert all(len({owner[x] for x in g if x in owner}) <= 1 for g in found)
    assert all(any(set(c) <= set(g) for g in found) for c in clear)


def test_one_of_each_group_stays(spark):
    a = " ".join(f"a{i}" for i in range(100))
    near = a.replace("a50 ", "other ")
    rows = [(5, a), (2, near), (2, near), (7, "b c d e f g"), (None, "b c d e f g"), (None, "no id at all in this text"), (None, "no id at all in this text")]
    kept = similar.drop_similar(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", root string, th int"))
    assert kept.columns == ["doc_id", "text", "root", "th"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([(2, near), (7, "b c d e f g"), (None, "no id at all in this text")], key=repr)
    assert similar.drop_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spanning_forest():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 40, 120), rng.integers(0, 40, 120)
    weight = rng.integers(0, 9, 120)
    chosen = similar.spanning_forest(40, left, right, weight)
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    best = 0
    for w, i, j in sorted(zip(weight, left, right, strict=True)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            best += w
    assert weight[chosen].sum() == best and len(chosen) == 40 - len({find(i) for i in range(40)})


def test_table_plan_grows_slowly():
    bits, tables = similar.table_plan(1 << 18)
    more_bits, more = similar.table_plan(1 << 24)
    assert (bits, more_bits) == (18, 24) and tables < more < 3.5 * tables


@pytest.mark.parametrize("prints", [100, 1 << 18, 1 << 24])
def test_tables_reach_the_recall_over_the_whole_spread(prints):
    rng = np.random.default_rng(7)
    # shared shingles, those of one only, those of the other only: all at 0.8
    for shared, left, right in [(4, 0, 1), (8, 1, 1), (48, 6, 6), (200, 25, 25), (800, 100, 100)]:
        short = shared + right <= similar.SHORT
        bits, tables = similar.spread_plan(prints, short=short)
        met = []
        for _ in range(400):
            g = rng.integers(0, 1 << 63, shared + left + right, dtype=np.int64).view(np.uint64)
            one, two = (np.array(similar.print_of(x), np.int64).view(np.uint64) for x in (g[: shared + left], np.r_[g[:shared], g[shared + left :]]))
            far = int(np.bitwise_count(one ^ two).sum())
            agree = np.prod([(similar.PRINT_BITS - far - i) / (similar.PRINT_BITS - i) for i in range(bits)])
            met.append((far <= similar.RADIUS) * (1 - (1 - agree) ** tables))
        assert np.mean(met) >= similar.RECALL - 0.02


def test_pairs_that_the_forest_of_a_large_cell_left_out_are_linked(spark):
    """Texts of one large cell whose forest edges are turned down: near copies of one text, two and two alike."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(400, 10, replace=False):
            own[at] = f"k{k}"
        rows.append((2 * k, " ".join(own)))
        for at in rng.choice(400, 8, replace=False):
            own[at] = f"n{k}"
        rows.append((2 * k + 1, " ".join(own)))
    got = similar.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.doc_id)
    want = {frozenset(rows[i][0] for i in g) for g in brute(rows)}
    assert {frozenset(g) for g in by.values()} == want


@pytest.mark.parametrize("block", [2, 256])
def test_left_out_links(spark, block):
    # a-b and b-c are the forest and turned down (0.78); a-c (0.81) was left out
    common = [f"w{i}" for i in range(300)]
    a, b, c = list(common), list(common), list(common)
    for k in range(4):
        a[20 + 60 * k] = "x"
        b[40 + 60 * k] = "y"
        b[10 + 60 * k] = "z"
        c[22 + 60 * k] = "v"
    texts = [" ".join(t) for t in (a, b, c)]
    assert jaccard(texts[0], texts[1]) < 0.8 and jaccard(texts[1], texts[2]) < 0.8 <= jaccard(texts[0], texts[2])
    near = [(1, texts[0].encode()), (2, texts[1].encode()), (3, texts[2].encode()), (4, b"far away from all others"), (5, b"")]
    edges = spark.createDataFrame([(1, 2, True), (2, 3, True), (2, 4, True), (4, 5, False)], "u bigint, v bigint, cut boolean")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    got = similar.left_out_links(edges, roots, spark.createDataFrame(near, "th bigint, text binary"), 0.8, block)
    assert {frozenset(r) for r in got.collect()} == {frozenset((1, 3))}
    joined = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "node bigint, root bigint")
    assert similar.left_out_links(edges, joined, spark.createDataFrame(near, "th bigint, text binary"), 0.8, block) is None


def test_sketches_turn_no_similar_pair_down():
    rng = np.random.default_rng(3)
    low, tried = [], 0
    for shared, left, right in [(1, 0, 0), (4, 0, 1), (8, 1, 1), (48, 6, 6), (200, 25, 25), (800, 100, 100), (9000, 1125, 1125)]:
        for _ in range(300 if shared < 1000 else 40):
            g = rng.integers(0, 1 << 63, shared + left + right, dtype=np.int64).view(np.uint64) * np.uint64(2)
            one, two = (np.frombuffer(similar.sketch_of(np.sort(x)), np.uint8) for x in (g[: shared + left], np.r_[g[:shared], g[shared + left :]]))
            tried += 1
            low.append(not similar.may_be_similar(one, two, 0.8))
    assert sum(low) == 0 and tried > 1800
    # texts of half the similarity are
    g = rng.integers(0, 1 << 63, 1000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    one, two = (np.frombuffer(similar.sketch_of(np.sort(x)), np.uint8) for x in (g[:700], g[300:]))
    assert not similar.may_be_similar(one, two, 0.8)
    empty = np.frombuffer(similar.sketch_of(np.zeros(0, np.uint64)), np.uint8)
    assert similar.may_be_similar(empty, empty, 0.8) and not similar.may_be_similar(empty, one, 0.8)


def test_thinned_edges_connect_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (900, 2))] + [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(pairs, "u bigint, v bigint").repartition(6)
    want = {(r.node, r.root) for r in similar.components(edges).collect()}
    thin = similar.thinned(edges, "t")
    assert thin.count() <= 400
    assert {(r.node, r.root) for r in similar.components(thin).collect()} == want
    batches = [similar.pa.record_batch([similar.pa.array([a]), similar.pa.array([b])], names=["u", "v"]) for a, b in pairs]
    from tallyforge.llm import common

    monkeypatch.setattr(common, "EDGES", 8)
    few = [(u, v) for b in common._forests(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert {(r.node, r.root) for r in similar.components(spark.createDataFrame(few, "u bigint, v bigint")).collect()} == want


def test_very_long_texts_and_wide_tables(spark):
    rng = np.random.default_rng(8)
    long = [f"w{x}" for x in rng.integers(0, 5000, 60_000)]
    near = list(long)
    for at in range(0, 60_000, 600):
        near[at] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(reversed(long))), (4, None), (5, "")]
    got = similar.similar_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", sketch string")).collect()
    by = {r.doc_id: r.root for r in got}
    assert by[1] == by[2] != by[3] and by[4] == by[5] and len(got) == 5
