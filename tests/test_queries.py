"""Every registered query against its SQL on DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare, connect  # noqa: E402
from spendloom.catalog import ORACLE_SQL, QUERIES  # noqa: E402


#: Without an SQL twin: tested against plain Python elsewhere.
PLAIN = {"f40_diff_or_rewrite"}
#: May have no rows in the smallest tables.
SPARSE = {"j8_skill_overlap", "t9_entropy", "w12_silent_runs"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PLAIN))
def test_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) > 0 or name in SPARSE


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
