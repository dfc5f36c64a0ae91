import re

import numpy as np
import pytest
import xxhash

from tallyforge.llm import neardup

SCHEMA = "doc_id bigint, text string"


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, part=neardup.PART):
    g = neardup.near_dup_groups(spark.createDataFrame(rows, SCHEMA), part=part)
    g = g.select("doc_id", neardup.fingerprint_hex(g.fp), "component_id")
    return sorted((tuple(r) for r in g.collect()), key=repr)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = list(rng.choice(vocab, rng.integers(60, 200)))
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            near = list(base)
            near[rng.integers(0, len(near))] = "changed"
            out.append(" ".join(near))
    return out


def test_equals_brute_force_with_odd_rows(spark):
    rows = list(enumerate(texts(60)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, rows[0][1]), (905, "Ä b c"), (3, rows[3][1]), (3, rows[3][1]), (None, "alone here now then")]
    want = brute_components(rows)
    assert run(spark, rows) == want
    # keys cut into many parts give the same groups
    assert run(spark, rows, part=2) == want


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    d = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id bigint, text string, fp int, root string")
    assert neardup.drop_near_dups(d).columns == d.columns and neardup.drop_near_dups(d).count() == 1


def test_drop_keeps_one_row_of_each_group(spark):
    a, b = texts(1, 5)[0], texts(1, 6)[0]
    rows = [(5, a), (2, a), (2, a), (7, b), (None, b), (None, "only this text has no id"), (None, "only this text has no id")]
    kept = neardup.drop_near_dups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(2, a), (7, b), (None, "only this text has no id")], key=repr)


@pytest.mark.parametrize("n", [1, 5, 64, 300])
@pytest.mark.parametrize("words,radius,most", [(1, 3, 7), (2, 32, 60), (1, 5, 9)])
def test_bit_sliced_pairs(n, words, radius, most):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, (n, words), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.choice(64 * words, rng.integers(0, most), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    stored = np.concatenate([base, near])
    left, right = neardup.close_pairs(stored, stored, radius)
    far = np.bitwise_count(stored[:, None, :] ^ stored[None, :, :]).sum(axis=2)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(far <= radius)], strict=True))


def test_many_cells_in_one_pass():
    rng = np.random.default_rng(6)
    size = np.array([1, 2, 63, 64, 65, 200, 3, 1, 130])
    start = np.cumsum(size) - size + 4
    p = rng.integers(0, 1 << 63, (int(size.sum()) + 9, 2), dtype=np.int64).view(np.uint64)
    for s, n in zip(start, size, strict=True):
        for i in range(1, n):
            if rng.random() < 0.4:
                p[s + i] = p[s + rng.integers(0, i)]
                for bit in rng.choice(128, rng.integers(0, 50), replace=False):
                    p[s + i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    left, right = neardup.close_in_cells(p, start, size, 37)
    want = {(i, j) for s, n in zip(start, size, strict=True) for i in range(s, s + n) for j in range(i + 1, s + n) if np.bitwise_count(p[i] ^ p[j]).sum() <= 37}
    assert len(left) == len(want) > 50 and set(zip(left.tolist(), right.tolist(), strict=True)) == want
