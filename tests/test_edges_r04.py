"""What a round's findings were about: a closure that matters to the decision."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare, connect  # noqa: E402
from spendloom.catalog import ORACLE_SQL, QUERIES  # noqa: E402


def test_closure_of_the_pull_reaches_further_parts(spark, tmp_path):
    """The wanted part was the largest key, which no link leaves: the closure was that part alone, whatever the links."""
    spark.createDataFrame([(i, 10 * i) for i in range(1, 7)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for links, want in ([(1, 1), (1, 3), (2, 3), (2, 4), (3, 2), (3, 6)], (3, 210, 101, 60, "pull")), ([(1, i) for i in range(1, 7)], (6, 210, 231, 0, "push")):
        spark.createDataFrame(links, "l_orderkey long, l_partkey long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        df = QUERIES["r4_pull_or_push"](spark, str(tmp_path))
        assert [tuple(r) for r in df.collect()] == [want]
        assert compare(df, connect(str(tmp_path)), ORACLE_SQL["r4_pull_or_push"]) == 1
