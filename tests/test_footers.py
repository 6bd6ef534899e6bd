"""Profiles of stored files from their footers."""

from pyspark.sql import functions as F

from ledgerfold.operators.profile import footer_counts, profile, profile_files


def test_footers_answer_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000, numPartitions=3).selectExpr(
        "id", "if(id % 4 = 0, null, cast(id as int)) as i", "if(id % 5 = 0, cast('NaN' as double), id + 0D) as d", "if(id % 10 = 0, null, 'x') as t",
        "array(id) as a", "date_add(date '2024-01-01', cast(id as int)) as day", "cast(null as string) as none",
        "id % 2 = 0 as flag", "id as `a.b c`").write.parquet(path)
    plan = footer_counts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "MIN(id)" in plan and "ReadSchema: struct<count(*)" in plan
    found = {r["column"]: r for r in profile_files(spark, path).collect()}
    for r in profile(spark.read.parquet(path)).collect():
        f = found[r["column"]]
        assert (f["dtype"], f["rows"], f["nulls"], f["null_ratio"]) == (r["dtype"], r["rows"], r["nulls"], r["null_ratio"])
    assert (found["id"]["minimum"], found["id"]["maximum"]) == ("0", "999") and found["day"]["minimum"] == "2024-01-01"
    assert found["d"]["nulls"] == 200 and found["d"]["maximum"] == "999.0" and found["t"]["minimum"] is None
    assert found["a.b c"]["maximum"] == "999" and found["flag"]["minimum"] == "False"


def test_empty_files(spark, tmp_path):
    spark.range(0).withColumn("x", F.lit(1.0)).write.parquet(str(tmp_path / "e"))
    assert [(r["rows"], r["nulls"], r["null_ratio"]) for r in profile_files(spark, str(tmp_path / "e")).collect()] == [(0, 0, None)] * 2
