from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tallyforge.llm import decontaminate, similar

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    one, two = (set(similar.shingle_set((t or "").encode()).tolist()) for t in (a, b))
    return len(one & two) / len(one | two) if one | two else 1.0


@pytest.fixture(scope="module")
def docs(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "123 456", "en", "src1", 7), (9004, base[0][1] + " " + item, "fr", "src2", 9), (None, base[1][1] + " end", "en", None, 1)]
    return base + odd


def test_stages_against_brute_force(spark, docs):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(docs, schema)
    text = {d[0]: d[1] for d in docs}

    known = pipeline.language_id(spark, frame, SF)
    ids = {r.doc_id for r in known.collect()}
    worded = {d[0] for d in docs if any(c.isalpha() for c in d[1] or "")}
    assert known.columns == frame.columns and ids <= worded and len(ids) >= 0.97 * len(worded)

    kept = pipeline.near_dedup(spark, known, SF)
    left = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame.columns and len(set(left)) == len(left)
    # every text that went has a similar one that stayed or a chain to it; no two that stayed are alike
    for d in ids - set(left):
        assert any(jaccard(text[d], text[o]) >= similar.SIMILARITY for o in ids if o != d)
    own = sorted(left, key=repr)
    assert not [1 for i, a in enumerate(own) for b in own[:i] if jaccard(text[a], text[b]) >= 0.85]
    for d in ids:
        if all(jaccard(text[d], text[o]) < similar.SIMILARITY for o in ids if o != d):
            assert d in left

    clean = pipeline.decontamination(spark, kept, SF)
    items = [d.text for d in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(list(enumerate(items)))
    assert {r.doc_id for r in clean.collect()} == {d for d in left if not index.leaks(text[d])} and 9004 not in {r.doc_id for r in clean.collect()}

    mixed = pipeline.source_mixing(spark, clean, SF)
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == frame.columns and set(taken) <= {r.doc_id for r in clean.collect()} and max(taken.values()) <= 2
    words = {d: len((t or "").split()) for d, t in text.items()}
    goal, got = 0.8 * sum(words[r.doc_id] for r in clean.collect()), sum(words[d] * n for d, n in taken.items())
    assert abs(got - goal) < 0.2 * goal + 100 * max(words.values())

    sharded = pipeline.sharding_stage(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in sharded) == taken and {r.shard for r in sharded} <= set(range(16))


def test_run_and_empty_input(spark, docs, tmp_path):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(0), SF).count() == 0, name
    out = pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "size"} <= set(out.columns) and out.count() > 50
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
