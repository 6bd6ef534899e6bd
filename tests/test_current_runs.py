"""Stored rows of the runs that readers see aren't dealt out by the run."""

import pytest
from pyspark.sql import functions as F

from ledgerfold.plans.increments import append_subscriptions, compact, remove_subscriptions
from ledgerfold.sources import Store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """No table counts as small, so that only a hint makes Spark broadcast one."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _subs(spark, dataset, n):
    return spark.range(n).select(
        F.lit(dataset).alias("dataset_id"), F.concat(F.lit("c"), "id").alias("customer_id"), F.lit("Pro").alias("plan"),
        F.lit("active").alias("status"), F.lit(False).alias("churned"), (F.col("id") * 1.0).alias("mrr"),
        F.lit("2023-01-05").cast("date").alias("start_date"), F.lit(None).cast("date").alias("churn_date"))


def test_rows_of_a_dataset_are_not_dealt_by_their_run(spark, tmp_path, no_small_tables):
    store = Store(spark, str(tmp_path))
    store.write_subscriptions(_subs(spark, "d", 50).unionByName(_subs(spark, "e", 5)))
    rows = store.table("subscriptions")
    assert "SortMergeJoin" not in _plan(rows) and "BroadcastHashJoin" in _plan(rows)
    assert rows.groupBy("dataset_id").count().orderBy("dataset_id").collect() == [("d", 50), ("e", 5)]


def test_pairs_of_a_dataset_with_many_runs_are_not_dealt_by_their_run(spark, tmp_path, no_small_tables):
    store = Store(spark, str(tmp_path))
    store.write_subscriptions(_subs(spark, "d", 20))
    for dataset in ("d", "d"):
        append_subscriptions(store, dataset, _subs(spark, dataset, 30))
    remove_subscriptions(store, "d", spark.createDataFrame([("c0",), ("c25",)], "customer_id string"))
    for table, n in (("subscriptions", 75), ("month_pairs", 1)):
        assert "SortMergeJoin" not in _plan(store.table(table))
        assert store.table(table).count() == n


def test_rows_written_anew_are_not_sorted_by_their_dataset(spark, tmp_path, monkeypatch):
    """Spark sorts what it writes by partition columns, all rows of a task at once, unless they are constants."""
    store, sorts, write = Store(spark, str(tmp_path)), [], Store.write_subscriptions

    def seen(self, df, *args, **kwargs):
        sorts.append([_plan(x).count("Sort [") for x in (df, df.sortWithinPartitions("dataset_id"))])
        write(self, df, *args, **kwargs)

    store.write_subscriptions(_subs(spark, "d", 40).unionByName(_subs(spark, "e", 5)))
    monkeypatch.setattr(Store, "write_subscriptions", seen)
    remove_subscriptions(store, "d", spark.sql("select * from values ('c0'), ('c7') as gone(customer_id)"))
    compact(store, "d")
    assert len(sorts) == 2 and all(plain == ordered for plain, ordered in sorts)
    assert store.table("subscriptions").groupBy("dataset_id").count().orderBy("dataset_id").collect() == [("d", 38), ("e", 5)]
