"""What the plans must and must not contain, whatever the table size."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerfold.operators.snapshot import monthly_snapshot

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "monthly_snapshot", "monthly_snapshot_by_dataset", "portfolio_summary", "validation_report",
    "anomalies", "enrich", "dashboard_summary", "q_plan_churn", "ops_counters", "check_referential",
])
def test_no_cartesian_product_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert word not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(queries()["q_total_active_mrr"](spark, SF_DIR))
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "o_orderpriority" not in orders and "o_orderdate" not in orders
    assert "lineitem" not in plan


def test_rows_are_combined_before_the_window(spark):
    """The running sum sees months; rows are reduced before the first shuffle."""
    df = spark.range(1000).select(
        F.lit(1).cast("decimal(12,2)").alias("mrr"),
        F.lit("2024-01-05").cast("timestamp_ntz").alias("start_date"),
        F.lit(None).cast("timestamp_ntz").alias("churn_date"))
    plan = plan_of(monthly_snapshot(df))
    assert plan.count("Range (0, 1000") == 1
    below_window = plan[plan.index("Window"):]
    assert "partial_count" in below_window and "partial_sum" in below_window


@pytest.mark.parametrize("by", [(), ("d",)])
@pytest.mark.parametrize("kind", ["double", "decimal(12,2)"])
def test_snapshot_joins_nothing(spark, by, kind):
    """Neither floating amounts nor a dominating dataset lead to a join or to pairs of months."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("large")).alias("d"),
        (F.col("id") % 7 + 0.1).cast(kind).alias("mrr"),
        F.timestamp_add("MONTH", (F.col("id") % 50).cast("int"), F.lit("2020-01-05").cast("timestamp_ntz")).alias("start_date"),
        F.when(F.col("id") % 3 == 0, F.timestamp_add(
            "MONTH", (F.col("id") % 61).cast("int"), F.lit("2020-01-09").cast("timestamp_ntz"))).alias("churn_date"))
    running = monthly_snapshot(df, by=by)
    assert "Join" not in plan_of(running) and "Cartesian" not in plan_of(running)
    key = [*by, "period"]
    other = monthly_snapshot(df, by=by, form="interval")
    assert running.orderBy(*key).collect() == other.orderBy(*key).collect()


def test_results_do_not_depend_on_the_time_zone(spark):
    names = ("monthly_snapshot", "derive_lifetime", "cast_dates", "month_period")
    before = {n: sorted(map(str, queries()[n](spark, SF_DIR).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = {n: sorted(map(str, queries()[n](spark, SF_DIR).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after
