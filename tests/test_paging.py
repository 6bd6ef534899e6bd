"""Pages by key equal pages by offset, and reach the scan as predicates."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.paging import behind, cursor_of, next_cursor, page, sorted_by

ROWS = [(random.Random(i).choice([None, 1.5, 2.0, 2.0, float("nan"), float("inf"), -0.0, 0.0]),
         random.Random(i + 999).choice([None, "a", "b'", 'c"d', "é"]), i) for i in range(60)]


@pytest.mark.parametrize("order", [
    (("x", False), ("t", False), ("k", False)), (("x", True), ("t", False), ("k", True)), (("t", True), ("x", True), ("k", False)),
    (("k", True),)])
@pytest.mark.parametrize("size", [1, 7, 60])
def test_pages_are_those_of_offsets(spark, order, size):
    df = spark.createDataFrame(ROWS, "x double, t string, k long").coalesce(2).cache()
    whole = [str(r) for r in df.orderBy(*sorted_by(order)).collect()]
    rows, cursor, found = df.orderBy(*sorted_by(order)).collect(), None, []
    for start in range(0, min(len(rows), 4 * size), size):  # the first pages, then the last ones from their cursors
        got = page(df, order, size, cursor).collect()
        found += map(str, got)
        cursor = next_cursor(got, order, size)
    assert found == whole[:len(found)]
    for at in (len(rows) - 2, len(rows) // 2, len(rows) - 1):
        got = page(df, order, size, cursor_of(rows[at], order)).collect()
        assert list(map(str, got)) == whole[at + 1:at + 1 + size]
    df.unpersist()


def test_a_page_is_a_top_k_behind_a_pushed_predicate(spark, tmp_path):
    spark.range(1000).selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as at").write.parquet(
        str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = (("at", False), ("id", False))
    third = df.filter("id = 500").first()
    rows = page(df, order, 10, cursor_of(third, order))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(at" in plan
    assert [r["id"] for r in rows.collect()] == list(range(501, 511))


def test_a_cursor_of_another_order_is_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        behind(df.schema, (("id", False),), "[1, 2]")
    assert next_cursor(df.collect(), (("id", False),), 4) is None
    assert df.filter(behind(df.schema, (("id", True),), cursor_of(df.filter("id = 1").first(), (("id", True),)))).agg(
        F.max("id")).first()[0] == 0
