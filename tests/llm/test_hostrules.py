import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hostrules

SCHEMA = "doc_id bigint, text string, source string"


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(grams)
    hit = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), len("".join(w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t", "one two", "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g", "x " * 40, "é# $ %&|<>\n" * 9, "w\nw\r\nw\nv",
    " ".join(f"t{i}" for i in range(3000)) + " " + " ".join(f"t{i}" for i in range(100, 108)), "a\x0bb\x0cc\xa0d  e", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 2 3 4 5 6 7 8 1",
]


def test_measures_equal_brute_force(spark):
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in hostrules.measures(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_a_large_bad_host_goes_and_a_small_one_is_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 20 else "bad", f"h{i % 9}") for i in range(900)]
    rows += [(1000 + i, good if i % 4 == 0 else "bad", "junk") for i in range(400)] + [(2000, "bad", "tiny"), (2001, good, "tiny")]
    rows += [(3000, good, None), (3000, good, None), (None, good, "junk")]
    judged = hostrules.judge(spark.createDataFrame(rows, SCHEMA))
    ok = {r.host: r.host_ok for r in judged.select("host", "host_ok").distinct().collect()}
    assert ok.pop("junk") is False and all(ok.values()) and None in ok
    assert judged.count() == len(rows) and judged.where("kept and base_failed").count() == 0
    assert judged.where("host = 'junk' and kept").count() == 0 and judged.where("host is null and kept").count() == 2
    rate = hostrules.host_verdicts(judged, {"failed": F.col("base_failed")}).where("host = 'tiny'").first().failed_rate
    assert 0.1 < rate < 0.5


def test_empty_table_clashing_columns_and_no_python(spark):
    assert hostrules.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(1, "a b", "s", True, 3, "x")], SCHEMA + ", kept boolean, n_words int, host string")
    assert hostrules.judge(d).first().n_words == 2
    plan = hostrules.judge(d)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


@pytest.mark.parametrize("same", [True, False])
def test_all_hosts_alike(spark, same):
    rows = [(i, "bad" if same else " ".join(str(j) for j in range(30)), f"h{i}") for i in range(5)]
    judged = hostrules.judge(spark.createDataFrame(rows, SCHEMA)).select("kept").collect()
    assert [r.kept for r in judged] == [not same] * 5
