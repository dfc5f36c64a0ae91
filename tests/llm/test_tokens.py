import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import queries, tokens

PATH = public_tokenizers.path(queries.TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "\n\n", "a", "it's we'll I'd've 's 'S", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>  z<|endo ftext|>",
    "two  spaces   three \n\t tabs \r\n end ", "  lead", "no break   \n b  wide　 ​ zero\u0085next \u001c sep\u001c\u001dx",
    "中文，没有空格。2024年、第3回 テスト", "emoji 👩‍👩‍👧 é é ﻿bom", "1234567890abc123.45,6;7", "!!! ... --- ?!x\u001c",
]


def whole(text):
    return len(PLAIN.encode(text, add_special_tokens=False))


def count(text, long=tokens.LONG):
    lens, safe = tokens._loaded(PATH)
    assert safe
    return sum(lens([p])[0] for p in tokens.pieces(text, long)) if text else 0


@pytest.mark.parametrize("long", [1, 7, tokens.LONG])
def test_pieces_are_safe(long):
    for t in [*ODD, "".join(ODD), " ".join(ODD)]:
        assert "".join(tokens.pieces(t, long)) == t
        assert count(t, long) == whole(t), t


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t  \u001c\u0085　aZé9٣中。.,!'s<|>endoftx́👧")), max_size=40), st.sampled_from([1, 5, 1000]))
def test_pieces_are_safe_for_any_text(t, long):
    assert "".join(tokens.pieces(t, long)) == t and count(t, long) == whole(t)


def test_query_equals_whole_texts(spark, tmp_path):
    rows = list(enumerate(ODD)) + [(100, None), (None, "no id"), (1, "x"), (1, "x"), (101, "word " * 1024), (102, "word " * 1023), (103, "long " * 60_000), (104, "a" * 100_000), (105, "ab12." * 40_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_token_counts(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and dict(out.dtypes)["n_tokens"] == "bigint"
    want = sorted(((i, len((t or "").encode()), whole(t or ""), whole(t or "") > 1024) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert {r.n_tokens for r in out.where("doc_id IN (101, 102)").collect()} == {1025, 1024}


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = tokens.count_tokens(docs, F.col("text"), PATH, keep=["doc_id", "text"], block=5_000).collect()
    assert len(got) == docs.count() and all(r.n_tokens == whole(r.text or "") for r in got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_read_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    lens, safe = tokens._loaded(path)
    assert not safe
    texts = [t for t in ODD if t.strip()] + ["Two words Here"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = dict((r.doc_id, r.n_tokens) for r in tokens.count_tokens(d, F.col("text"), path).collect())
    assert [got[i] for i in range(len(texts))] == lens(texts)


def test_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b", 9, "k")], "doc_id int, text string, n_tokens int, `_row` string")
    assert tokens.count_tokens(d, F.col("text"), PATH).columns == ["doc_id", "text", "_row", "n_bytes", "n_tokens", "over_limit"]
    assert tokens.count_tokens(d, F.col("text"), PATH).first()[:3] == (1, "a b", "k")
    assert tokens.count_tokens(d.limit(0), F.col("text"), PATH).collect() == []
