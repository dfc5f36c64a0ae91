from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import decontaminate as d

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items):
    out = []
    for doc, text in docs:
        words = d.plain_words(text)
        for key, item in items:
            iw = d.plain_words(item)
            if not iw:
                continue
            if len(iw) < d.SHINGLE:
                out += [(doc, key, 1.0)] if any(words[a : a + len(iw)] == iw for a in range(len(words))) else []
                continue
            n = min(len(iw), len(words))
            sims = [d.weighted_jaccard(d.shingles(words[a : a + n]), d.shingles(iw)) for a in range(len(words) - n + 1)]
            if sims and max(sims) >= d.SIMILARITY:
                out.append((doc, key, round(max(sims), 9)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    marked = d.mark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    return sorted(((r.doc_id, x.item_id, round(x.similarity, 9)) for r in marked.collect() for x in r.leaks), key=repr)


def cases():
    rng = np.random.default_rng(11)
    vocab = [f"w{i}é" for i in range(500)]
    say = lambda n: list(rng.choice(vocab, n))
    items = [(i, say(int(rng.integers(5, 70)))) for i in range(40)]
    docs = []
    for i in range(120):
        key, passage = items[int(rng.integers(0, 40))]
        passage = list(passage)
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(passage)))
            [passage.pop, lambda k: passage.insert(k, "new"), lambda k: passage.__setitem__(k, "new")][int(rng.integers(0, 3))](at)
        docs.append((i, " ".join(say(int(rng.integers(0, 50))) + passage + say(int(rng.integers(0, 50)))).upper() if i % 2 else ", ".join(passage)))
    items = [(k, " ".join(w).capitalize() + ".") for k, w in items]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1]), (None, "an item that has no id at all"), (104, "la la la la la la la la")]
    docs += [(200, None), (201, ""), (202, "Too, SHORT"), (203, "too short for this"), (204, items[0][1]), (204, items[0][1]), (None, "x an item that has no id at all"), (205, "la " * 5000), (206, "clean words only " * 40)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 2500])
def test_equals_brute_force(spark, block_bytes):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 40
    assert run(spark, docs, items, block_bytes=block_bytes) == want


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    windows = items[rng.integers(0, 300, 200)].copy()
    for w in windows:
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            w[bit // 8] ^= 1 << (bit % 8)
    got = d.SizeIndex.of(list(range(300)), items).within_radius(windows)
    far = np.bitwise_count(windows[:, None, :] ^ items[None, :, :]).sum(axis=2)
    assert set(zip(*[x.tolist() for x in got], strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(far <= d.RADIUS)], strict=True))


def test_similarity_counts_repeats():
    assert d.weighted_jaccard(Counter("aab"), Counter("abb")) == 0.5


def test_dropping_and_odd_tables(spark):
    docs, items = cases()
    full = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS + ", leaks int, item_id string")
    bench = spark.createDataFrame(items, ITEMS)
    kept = d.drop_leaks(full, bench)
    # a short item counts where it is the whole text
    of, texts = dict(items), {}
    for k, t in docs:
        texts.setdefault(k, t)
    hit = {k for k, i, _ in brute(docs, items) if len(d.plain_words(of[i])) >= d.SHINGLE or d.plain_words(of[i]) == d.plain_words(texts[k])}
    assert kept.columns == full.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in docs if r[0] not in hit), key=repr)
    assert d.drop_leaks(full, bench.limit(0)).count() == len(docs) and d.drop_leaks(full.limit(0), bench).count() == 0


def test_short_items_are_found_within_texts_and_drop_no_long_text(spark):
    items = [(1, "Yes!"), (2, "blue whale"), (3, "one two three four"), (4, "blue whale")]
    docs = [(1, "the Blue, whale sang; the blue whale left"), (2, "yes"), (3, "Yes it is one two three four five"), (4, "yesterday bluewhale"), (5, None), (6, "blue whale.")]
    assert run(spark, docs, items) == sorted([(1, 2, 1.0), (1, 4, 1.0), (2, 1, 1.0), (3, 1, 1.0), (3, 3, 1.0), (6, 2, 1.0), (6, 4, 1.0)], key=repr)
    marked = d.mark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where("doc_id = 1").first()
    assert {(x.item_id, x.start_word, x.n_words) for x in marked.leaks} == {(2, 1, 2), (4, 1, 2)}
    kept = d.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
