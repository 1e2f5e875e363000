"""What a round's findings were about: results that don't depend on how tables are split, and work that is dealt by its size."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare, connect  # noqa: E402
from spendloom.catalog import ORACLE_SQL, QUERIES  # noqa: E402
from spendloom.functions.texts import embedding  # noqa: E402
from spendloom.operators import graphs, neighbours  # noqa: E402
from spendloom.plans import spread  # noqa: E402


def test_sums_are_made_in_order_of_events(spark, tmp_path):
    """1e16 + 1 - 1e16 is 0 in doubles in this order; it was 1 where the second event was in a file of its own."""
    for n, rows in enumerate([[(1, 1, "view", 1e16), (3, 1, "view", -1e16)], [(2, 1, "purchase", 1.0)]]):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["f16_retry_or_reframe"](spark, str(tmp_path)).collect()] == [(1, 0.0, 0.0, "retry")]


def test_grams_that_cancel_leave_no_residue():
    text = 'En éenoupa enauxanré de ouquepa lelele treaux èêè èleaux. Onelle, èentre un pas.\nÈaux menttion elle choi èéier une èvié aiaux éoienon ouoiré la enè aioielleon la et, un par. Ououquevich. La èeautionou, réoiou une levi. Lesèanou et ononè le. Quech queelletre aitre éanreelle éeauré enleè treauxpa de éle.\nEuxê éoueau oi eux ellequere éaire ouenre aieaument, de enier réchpa èentre queeau qui.\nAux échçre çeuxaux quetionvi aiieren de enier de et laonchaux leéonéré ètion aieaueau éviré èeauleoi, èeuxé ierque quetre les éèquetre de oneux élement un èré paqueai éelle pour les les la par et menton lesèaiqueç ailetre lementaux, une la. Èanan la épaoution éètrevi. Oueux auxèai éouêaux de, aiment, réauxtre ouvieau oument entioniereux éê euxèen uneentreêç ier au une enou la au de ouanvique, èanqueelle.'
    assert embedding(text)[146] == 0


def test_parts_do_not_grow_with_their_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 10)
    monkeypatch.setattr(spread, "TEXT_ROWS", 10)
    df = spark.range(200)
    df.write.parquet(f"{tmp_path}/t")
    assert spread.dealt(df, 200, "id").rdd.getNumPartitions() == 20 and spread.dealt(df, 10, "id") is df
    assert spread.dealt_texts(spark.read.parquet(f"{tmp_path}/t"), "id").rdd.getNumPartitions() == 20
    assert QUERIES["r7_keyword_search"].texts == QUERIES["j8_skill_overlap"].texts == ("documents",)


def test_reach_by_large_frontiers_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 10)
    monkeypatch.setattr(graphs, "SENT", 2)
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in (2 * i, 2 * i + 1, 2 * i + 1) if 0 < i and j < 40] + [(None, 3)], "src int, dst int")
    got = {r.id: r.distance for r in graphs.reach(edges, spark.createDataFrame([(1,)], "id int")).collect()}
    assert got == {i: i.bit_length() - 1 for i in range(1, 40)}


def test_scores_of_a_step_are_few(spark):
    assert neighbours.STEP * neighbours.BLOCK * 8 <= 16 << 20
    n = neighbours.STEP * 2 + 5
    v = spark.range(n).selectExpr("id AS vec_id", f"array(CAST(cos(id * 3.1 / {n}) AS FLOAT), CAST(sin(id * 3.1 / {n}) AS FLOAT)) AS embedding").coalesce(1)
    got = {r.query_id: r.vec_id for r in neighbours.nearest(v, v.where("vec_id % 100 = 0")).collect()}
    assert set(got) == set(range(0, n, 100)) and all(abs(q - i) == 1 for q, i in got.items())


@pytest.mark.parametrize("name", ["a23_dominant_model", "a5_task_ledger", "f13_futures_quote", "q8_recommend"])
def test_joins_are_dealt_into_parts_that_do_not_grow(spark, sf_dir, monkeypatch, name):
    """Line items met their orders in spark.sql.shuffle.partitions parts, however many they were."""
    monkeypatch.setattr(spread, "ROWS", 100)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    rows = tables["lineitem"].count()
    assert spread.dealt_joins(tables) == tables  # orders are sent
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = -(-rows // 100)
        got = spread.dealt_joins(tables)
        assert got["lineitem"].rdd.getNumPartitions() == got["customer"].rdd.getNumPartitions() == min(200, parts) and got["orders"] is tables["orders"]
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        for key in ("l_orderkey", "o_orderkey"):
            assert re.search(rf"Exchange hashpartitioning\({key}#\d+L, {min(200, parts)}\)", plan)
        assert compare(df, connect(sf_dir), ORACLE_SQL[name]) > 0
        monkeypatch.setattr(spread, "UNSORTED", 10)
        assert spread.dealt_joins(tables)["lineitem"].rdd.getNumPartitions() == -(-parts // 2)
        monkeypatch.setattr(spread, "ROWS", rows)
        assert spread.dealt_joins(tables) == tables
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
