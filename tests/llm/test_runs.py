import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import queries, runs


def brute(w):
    """All runs by definition: every lag, every maximal stretch, the smallest period of each."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def altered(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def digest(doc_id, text):
    w = altered(doc_id, text)
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, exponent, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_every_run_of_random_words():
    rng = np.random.default_rng(2)
    for n in range(400):
        w = [b"%d" % x for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))]
        assert runs.find_runs(w) == brute(w), n
        # planted powers, with a phrase that itself holds repeats
        base = [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 25))]
        w = w + base * int(rng.integers(2, 9)) + w[:7] + (base[:3] * 5)
        assert runs.find_runs(w) == brute(w), n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=70))
def test_every_run_of_two_words(w):
    assert runs.find_runs(w) == brute(w)


def test_square_free_and_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert runs.find_runs(b) == brute(b)
    thue = [b"0"]
    for _ in range(8):
        thue += [b"1" if x == b"0" else b"0" for x in thue]
    assert runs.find_runs(thue) == brute(thue) == []


def test_very_long_texts_take_few_seeds():
    w = [b"x"] * 200_000
    assert runs.find_runs(w) == [(0, 200_000, 1)]
    phrase = [b"%d" % i for i in range(5_000)]
    assert runs.find_runs([b"s", *phrase * 20, b"e"]) == [(1, 100_000, 5_000)]
    mixed = (phrase[:50] * 4 + phrase[100:150] * 5) * 300
    found = runs.find_runs(mixed)
    assert (0, len(mixed), 450) in found and len(found) == 601
    # neighbouring places only: the seeds grow with the text, not with the square of a phrase's places
    assert sum(1 for _ in runs.seeds(np.zeros(20_000, int))) < 20_000


def rows():
    rng = np.random.default_rng(6)
    out = []
    for i in range(150):
        w = [f"w{x}é" for x in rng.integers(0, 3 if i % 4 == 0 else 200, rng.integers(1, 90))]
        out.append((i, " \n".join(w)))
    planted = [i for i in range(1000, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    out += [(i, " ".join(f"p{x}" for x in rng.integers(0, 500, rng.integers(1, 200)))) for i in planted]
    out += [(5000, None), (5001, ""), (5002, "\t \n"), (5003, "a " * 5), (5004, "a " * 6), (None, "b c " * 9), (None, None)]
    out += [(planted[0], None), (planted[1], " "), (planted[2], "one"), out[3], out[3], (5005, "a  " * 3000 + "b c d " * 900)]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((digest(*r) for r in data), key=repr)


def test_operator_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b " * 4 + "c", 7, "x")], "doc_id bigint, text string, runs int, `odd name` string")
    (r,) = runs.mark_runs(d, d["text"]).collect()
    assert r.asDict(True) == {"doc_id": 1, "text": "a b " * 4 + "c", "odd name": "x", "runs": [{"start": 0, "length": 8, "period": 2}], "collapsed": "a b c"}
    assert runs.mark_runs(d.limit(0), d["text"]).collect() == []
