import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import langid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.where("doc_id % 2 = 0"), F.col("doc_id"), F.col("text"), F.col("lang"))


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1 and text rlike '[a-z]'")
    done = langid.identify(docs, net)
    assert done.where("lang_pred = lang").count() >= 0.95 * docs.count()
    assert done.where("lang_score not between 0 and 1").count() == 0
    assert langid.known_language(docs, net).count() >= 0.95 * docs.count()


def test_odd_rows_and_clashing_columns(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400")
    en, de = (docs.where(f"lang = '{x}'").orderBy("doc_id").first().text for x in ("en", "de"))
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 + 5 \n", "c"), (4, en, "d"), (4, en, "d"), (None, de * 300, "e")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.lang_score) for r in langid.identify(d, net).collect())
    assert [x[1] for x in got] == ["de", "und", "und", "und", "en", "en"] and got[1][2] == 0
    assert langid.known_language(d, net).columns == d.columns and langid.known_language(d, net).count() == 3
    assert langid.identify(d.limit(0), net).count() == 0
    assert {r.lang_pred for r in langid.identify(d, None).collect()} == {"und"}


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert langid.train(d, F.col("doc_id"), F.col("text"), F.col("lang")) is None


def test_every_byte_is_in_a_window():
    texts = [b"", b"x", bytes(range(1, 126)), bytes(i % 251 + 1 for i in range(1000))]
    windows, owner, held = langid.windows_of(texts)
    for i, t in enumerate(texts):
        own = windows[owner == i]
        assert b"".join(w[: langid.STEP].tobytes() for w in own).rstrip(b"\0") == t
        assert held[owner == i].sum() == max(len(t), 1)
    # the pair tables say the same as the filters themselves
    rng = np.random.default_rng(0)
    net = langid.fit([bytes(rng.integers(1, 255, 128)) for _ in range(20)], ["a", "b"] * 10, epochs=1)
    first, second = net.tables()
    pooled = langid._pool(first, second, windows)
    for t, w, at in zip(net.taps, langid.WIDTHS, (0, 16, 32), strict=True):
        direct = sum(t[k][windows[:, k : k + langid.STEP]] for k in range(w)).max(axis=1)
        assert np.allclose(pooled[:, at : at + 16], direct, atol=1e-5)
