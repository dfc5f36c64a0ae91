import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import phrases

W = phrases.WINDOW


def brute(rows):
    seen = Counter()
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    for _, w in split:
        for i in range(len(w) - W + 1):
            seen[tuple(w[i : i + W])] += 1
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - W + 1):
            if seen[tuple(w[i : i + W])] > 1:
                gone.update(range(i, i + W))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(4)
    vocab = [f"v{i}é" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    common, long, short = say(50), say(400), say(34)
    rows = []
    for i in range(60):
        parts = [say(int(rng.integers(1, 120)))]
        if i % 3 == 0:
            parts.append(common)
        if i % 7 == 0:
            at = int(rng.integers(0, 300))
            parts.append(" ".join(long.split()[at : at + int(rng.integers(30, 100))]))
        if i % 5 == 0:
            parts.append(short)
        parts.append(say(int(rng.integers(1, 60))))
        rows.append((i, " \n".join(parts)))
    rows += [(100, long), (101, rows[1][1]), (101, rows[1][1]), (102, "x " * 500), (103, common + " " + common), (104, None), (105, ""), (106, "few words"), (None, rows[2][1]), (None, long)]
    rows += [(107, " ".join(["a b c"] * 40)), (108, say(35)), (109, rows[8][1].replace(" ", "\t"))]
    return rows


@pytest.mark.parametrize("hot", [phrases.HOT, 3])
def test_equals_brute_force(spark, hot):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in phrases.digests(d, hot=hot).collect()), key=repr) == brute(rows)


def test_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in phrases.digests(d).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_empty_table_and_clashing_columns(spark):
    assert phrases.digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    d = spark.createDataFrame([(1, "a b", "k", 5)], "doc_id bigint, text string, key string, th int")
    assert [tuple(r)[:3] for r in phrases.digests(d).collect()] == [(1, 2, 0)]


def test_only_the_automata_mark_places(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    group = {(text + " a b").encode(): 1, ("c " + text).encode(): 1, " ".join(f"u{i}" for i in range(80)).encode(): 1}
    found = phrases.passages(group)
    assert found == {text.encode()}
    assert phrases.locate(found, [*group, b"w1 w2", (text + " x " + text).encode()]) == [[0, 60], [1, 61], [], [], [0, 60, 61, 121]]
    # without the automaton nothing is located and every text stays whole
    monkeypatch.setattr(phrases, "locate", lambda patterns, segments: [[] for _ in segments])
    blocks = [b for b in phrases._shards(iter([phrases.pa.record_batch([[1, 1], list(group)[:2], [1, 1]], names=["key", "segment", "n"])]))]
    assert sum(b.num_rows for b in blocks) == 0


def test_very_long_texts(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in rng.integers(0, 90_000, 40_000))
    rows = [(1, long), (2, "start " + long[: len(long) // 2]), (3, " ".join(f"z{i}" for i in range(20_000)))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in phrases.digests(d).collect()), key=repr) == brute(rows)
