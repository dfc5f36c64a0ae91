import collections
import math
import re
import time
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import bounds
from tallyforge.llm import brown

DOCS = "/root/testdata/sf0.001/documents.parquet"


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), ""]


def check_base(rows, train, got):
    c = collections.Counter()
    for _, t in train:
        c.update(toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for d, t in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want


def test_base_scores_and_a_better_model(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    model, vocab = brown.fit(brown.training_texts(docs, F.col("doc_id") % 5 != 0), rounds=4)
    got = brown.score(docs, model, vocab).collect()
    rows = [tuple(r) for r in docs.collect()]
    check_base(rows, [r for r in rows if r[0] % 5], got)
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)  # log10: less negative
    # transitions and emissions are distributions
    assert np.allclose((10**model.step).sum(axis=1), 1) and (model.step < 0).all()
    t = model.types
    words = np.array(sorted(t.words.values()))
    for k in range(len(model.step)):
        own = words[model.cls[words] == k]
        assert (10 ** model.emit[own]).sum() <= 1 + 1e-9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (3, "A a\tb"), (None, "b c é"), (4, "a " * 30000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, vocab = brown.fit(brown.training_texts(d, F.lit(True)), rounds=2)
    check_base(rows, rows, brown.score(d, model, vocab).collect())
    assert brown.score(d.limit(0), model, vocab).count() == 0
    # nothing to learn from: one unknown word
    model, vocab = brown.fit(brown.training_texts(d, F.lit(False)), rounds=1)
    got = brown.score(d, model, vocab).collect()
    check_base(rows, [], got)
    assert all(math.isfinite(r.score) for r in got)


def test_exchange_gain_is_the_likelihood_gain():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 6, (12, 12)).astype(float)
    cls = np.array([0, *(1 + np.arange(11) % 4)])

    def matrix(c):
        m = np.zeros((5, 5))
        np.add.at(m, (c[:, None].repeat(12, 1), c[None, :].repeat(12, 0)), n)
        return m

    def likelihood(c):
        m = matrix(c)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    for w in range(1, 12):
        left, right = np.zeros(5), np.zeros(5)
        np.add.at(left, cls, n[:, w])
        np.add.at(right, cls, n[w, :])
        m = matrix(cls)
        best = brown.best_class(m, cls[w], left, right, n[w, w])
        options = {k: likelihood(np.where(np.arange(12) == w, k, cls)) for k in range(1, 5)}
        assert options[best] >= max(options.values()) - 1e-6
        cls[w] = best
        assert np.allclose(m, matrix(cls))


def test_many_words_move_as_one_would():
    rng = np.random.default_rng(7)
    k = 7
    c = rng.integers(0, 40, (k, k)).astype(float)
    own, left, right, self_n = [], [], [], []
    for _ in range(300):
        o = rng.integers(1, k)
        a, b = rng.poisson(rng.choice([0.2, 2, 9]), (2, k))
        s = rng.integers(0, 3)
        a[o] += s
        b[o] += s
        own.append(o)
        left.append(a)
        right.append(b)
        self_n.append(s)
    c += 3 * np.max(left, axis=0)[:, None] + 3 * np.max(right, axis=0)[None, :]  # each word's counts are in the cells
    got = brown.best_classes(c, np.array(own), np.array(left), np.array(right), np.array(self_n, dtype=float))
    want = [brown.best_class(c.copy(), o, a.astype(float), b.astype(float), s) for o, a, b, s in zip(own, left, right, self_n, strict=True)]
    assert got.tolist() == want and len(set(want)) > 3


def rare_world(spark):
    """Frequent words in two kinds of phrases; words seen once to four times, all with one ending, in one kind each."""
    rng = np.random.default_rng(5)
    first, second = ([f"{a}{i}" for i in range(6)] for a in "xy")
    rows = []
    for i in range(600):
        a, b = rng.choice(first, 2), rng.choice(second, 2)
        rows.append((i, f"{a[0]} {b[0]} {a[1]} {b[1]}"))
    for i in range(60):  # in the place of a word of the first kind, or of the second
        a, b = rng.choice(first, 2), rng.choice(second, 2)
        for _ in range(1 + i % 4):
            rows.append((len(rows), f"{a[0]} {b[0]} rare{i}ing {b[1]}" if i % 2 else f"{a[0]} alt{i}ing {a[1]} {b[1]}"))
    rows.append((len(rows), "rare1ing rare1ing rare1ing new1 unseen x0 X1"))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_rare_words_find_their_own_classes(spark, monkeypatch):
    monkeypatch.setattr(brown, "TYPE_SHARE", 100)  # rare: below 1 % of the tokens, so no rare word is a type
    monkeypatch.setattr(brown, "NEAR_SHARE", 1000)
    monkeypatch.setattr(brown, "GROUP", 7)
    d, rows = rare_world(spark)
    train = F.col("doc_id") % 7 != 3
    model, done = brown.fit_and_score(d, train, classes=6)
    look = model.known.look
    encoded = brown.encode(d.where(train).select("doc_id", F.lit(True).alias("train"), F.col("text").cast("binary")), look)
    cls, matrix = brown.exchange(brown.settle(brown.type_pairs(encoded, look), "pairs"), look.types, 6)
    assert (cls == model.cls).all()
    table = {bytes(r.word).decode(): (r.n, r.cls) for r in brown.rare_classes(encoded, look, cls, matrix).collect()}

    # each rare word: its own profile against the classes of the exchange
    texts = [["", *toks(t)] for i, t in rows if i % 7 != 3]
    count = collections.Counter(w for t in texts for w in t[1:])
    start = {w: int(cls[look.types.of(w.encode())]) for w in count}
    assert set(table) == {w for w in count if w.encode() not in look.types.words} and any(count[w] == 1 for w in table)
    for w, got in table.items():
        left, right, s = np.zeros(len(matrix)), np.zeros(len(matrix)), 0
        for t in texts:
            for u, v in zip(t, t[1:], strict=False):
                left[start[u]] += v == w
                right[start[v]] += u == w
                s += u == v == w
        assert got == (count[w], brown.best_class(matrix.copy(), start[w], left, right, s)), w
    # one ending, two kinds of words: they share a class until they move
    assert len({start[w] for w in table if w.endswith("ing")}) == 1
    kinds = [{c for w, (_, c) in table.items() if w.startswith(x)} for x in ("rare", "alt")]
    assert kinds[0] != kinds[1]

    # scores of all texts, from the definition
    final = {w: table[w][1] if w in table else start[w] for w in count}
    pairs = np.zeros_like(matrix)
    for t in texts:
        for u, v in zip(t, t[1:], strict=False):
            pairs[final[u], final[v]] += 1
    n, k = sum(count.values()), len(matrix)
    share = (pairs.sum(axis=0) + 0.1) / (n + 0.1 * k)
    mass = np.zeros(k)
    for w, c in final.items():
        mass[c] += count[w] + 0.1
    of = lambda w: final.get(w, int(cls[look.types.of(w.encode())]))
    want = {}
    for i, t in rows:
        path = ["", *toks(t)]
        want[i] = sum(math.log10((pairs[of(u), of(v)] + share[of(v)]) / (pairs[of(u)].sum() + 1)) + math.log10((count[v] + 0.1) / (mass[of(v)] + 0.1)) for u, v in zip(path, path[1:], strict=False))
    got = {r.doc_id: r.score for r in done.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    check_base(rows, [r for r in rows if r[0] % 7 != 3], done.collect())
    # chunks and the two ways in give the same
    monkeypatch.setattr(brown, "CHUNK", 100)
    again, vocab = brown.fit(brown.training_texts(d, train), classes=6)
    apart = {r.doc_id: r.score for r in brown.score(d, again, vocab).collect()}
    assert max(abs(got[i] - apart[i]) for i in got) < 1e-9


def test_little_stays_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(brown, "TYPE_SHARE", 100)
    monkeypatch.setattr(brown, "NEAR_SHARE", 200)
    monkeypatch.setattr(bounds, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    d, rows = rare_world(spark)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {p.name for x in dirs for p in Path(x).rglob("shuffle_*")}
    before = shuffles()
    model, done = brown.fit_and_score(d, F.col("doc_id") % 7 != 3, classes=6, rounds=2)
    # of all tables on the way the one that the result reads, and no shuffle files, once the removals are through
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["classed"]
    until = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert done.count() == len(rows)
    # a chunk lists a word once, however many places it has
    look = model.known.look
    for r in brown.encode(d.select("doc_id", F.lit(True).alias("train"), F.col("text").cast("binary")), look).collect():
        words, far, seq = r.words.split(), np.frombuffer(r.far, np.int32), np.frombuffer(r.seq, look.dtype)
        assert len(words) == len(set(words)) and not set(words) & set(look.near)
        told = iter(far)
        got = [look.near[k] if k < len(look.near) else words[next(told)] for k in seq]
        of = dict(rows)
        assert got == [b"", *(w.encode() for i in r.doc_id for w in toks(of[i]))] and next(told, None) is None
