from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 140


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
def test_entry_runs(spark):
    d = entry.entry(spark)
    assert d.count() == 3 and "balanced_acc" in d.columns
