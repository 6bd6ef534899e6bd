from datetime import datetime

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.operators.clean import (
    cap_outliers_iqr, cast_bools, cast_dates, cast_numerics, classify_columns, clean, dedup_rows,
    drop_high_null, fill_numeric_median, infer_numeric_text,
)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([
        ("c1", 100.0, False, "2023-01-01", "US", None),
        ("c2", 200.0, True, "2023-02-01", "BR", None),
        ("c3", None, False, "2023-03-01", None, None),
        ("c4", 400.0, True, "2023-04-01", "DE", None),
        ("c5", 500.0, False, "2023-05-01", "UK", None),
    ], "customer_id string, mrr double, churned boolean, start_date string, country string, "
       "junk_col string")


def test_whole_sequence(sample):
    result = clean(sample)
    report = result.report()
    rows = {r["customer_id"]: r for r in result.frame.collect()}
    assert "junk_col" not in result.frame.columns and report.columns_dropped == ["junk_col"]
    assert rows["c3"]["mrr"] == 300.0 and rows["c3"]["country"] == "unknown"
    assert rows["c1"]["start_date"] == datetime(2023, 1, 1)
    assert dict(result.frame.dtypes)["churned"] == "boolean"
    assert (report.original_rows, report.final_rows) == (5, 5)
    assert report.nulls_filled == {"mrr": 1, "country": 1}
    assert report.type_conversions == {"mrr": "float", "churned": "bool", "start_date": "datetime"}


def test_duplicates(spark):
    df = spark.createDataFrame([("c1", 100), ("c1", 100), ("c2", 200)], "customer_id string, mrr int")
    result = clean(df)
    assert result.frame.count() == 2
    assert result.report().duplicates_removed == 1


def test_nulls_and_nan_are_equal_in_duplicates(spark):
    df = spark.createDataFrame(
        [(None, float("nan")), (None, None), ("a", 1.0)], "k string, v double")
    assert dedup_rows(df).count() == 2


def test_outlier_is_capped_at_the_fence(spark):
    values = [100, 110, 105, 108, 99, 102, 10000]
    result = clean(spark.createDataFrame([(v,) for v in values], "mrr int"))
    assert max(r["mrr"] for r in result.frame.collect()) == 133.0
    assert result.report().outliers_capped == {"mrr": 1}


def test_column_without_outliers_keeps_its_type(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(20)], "customer_no bigint")
    frame = cap_outliers_iqr(df)
    assert frame.dtypes == [("customer_no", "bigint")]
    assert frame.agg(F.max("customer_no")).first()[0] == 2**60 + 19


def test_bool_texts_are_case_exact(spark):
    df = spark.createDataFrame([(t,) for t in ("true", "True", "YES", "yes", "1", "0", "2", None)],
                               "churned string")
    assert [r[0] for r in cast_bools(df).collect()] == [
        True, False, False, True, True, False, False, False]
    numbers = spark.createDataFrame([(1,), (0,), (2,), (None,)], "active int")
    assert [r[0] for r in cast_bools(numbers).collect()] == [True, False, False, False]


def test_number_texts(spark):
    texts = [" 12 ", "1,000", "NaN", "inf", "-Infinity", "1e3", ".5", "5.", "1d", "0x10", "abc", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "mrr string")
    assert [r[0] for r in cast_numerics(df).collect()] == [
        12.0, None, None, float("inf"), float("-inf"), 1000.0, 0.5, 5.0, None, None, None, None, None]


def test_dates(spark):
    df = spark.createDataFrame(
        [("2023-01-05",), ("2023-01-05 10:30:00",), ("nonsense",), (None,), ("05/02/2023",)],
        "created_at string")
    plain = [r[0] for r in cast_dates(df).collect()]
    assert plain == [datetime(2023, 1, 5), datetime(2023, 1, 5, 10, 30), None, None, datetime(2023, 5, 2)]
    assert cast_dates(df, ("dd/MM/yyyy",)).collect()[4][0] == datetime(2023, 2, 5)
    nanos = spark.createDataFrame([(1_700_000_000_000_000_000,)], "updated_at bigint")
    assert cast_dates(nanos).first()[0] == datetime(2023, 11, 14, 22, 13, 20)


def test_numeric_share_is_of_all_rows_and_strict(spark):
    four_of_five = [("1",), ("2",), ("3",), ("4",), ("x",)]
    df = spark.createDataFrame(four_of_five, "code string")
    assert infer_numeric_text(df).dtypes == [("code", "string")]
    assert infer_numeric_text(df.filter("code <> 'x'")).dtypes == [("code", "double")]
    with_null = spark.createDataFrame([("1",), ("2",), (None,)], "code string")
    assert infer_numeric_text(with_null).dtypes == [("code", "string")]


def test_half_null_is_kept_and_protected_columns_stay(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (3, "a", None), (4, "b", None)],
                               "k int, half string, churn_date string")
    assert drop_high_null(df).columns == ["k", "half"]
    assert drop_high_null(df, protect=("churn_date",)).columns == ["k", "half", "churn_date"]


def test_empty_table_and_all_null_column(spark):
    empty = spark.createDataFrame([], "customer_id string, mrr double")
    result = clean(empty)
    assert result.frame.count() == 0 and result.report().columns_dropped == []
    nulls = spark.createDataFrame([("a", None), ("b", None)], "k string, mrr double")
    assert clean(nulls, protect=("mrr",)).frame.filter("mrr is null").count() == 2


def test_classes():
    assert classify_columns(["Start_Date", "cancelled_at", "Churned", "arrival", "mrr_usd", "plan"]) == {
        "Start_Date": "date", "cancelled_at": "date", "Churned": "bool", "arrival": "numeric",
        "mrr_usd": "numeric", "plan": "other"}


_NUMBERS = st.lists(
    st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, width=32)),
    min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_NUMBERS)
def test_fill_and_cap_agree_with_sql(spark, values):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "k int, v double")
    con = duckdb.connect()
    con.execute("create table t (k int, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    con.execute("create view f as select k, coalesce(v, (select quantile_cont(v, 0.5) from t)) as v from t")
    want = dict(con.execute("""select k, greatest(least(v, q3 + 3 * (q3 - q1)), q1 - 3 * (q3 - q1))
      from f, (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from f)""").fetchall())
    present = [v for v in values if v is not None]
    got = dict(clean(df.select("k", F.col("v")), protect=("v",)).frame.select("k", "v").collect())
    for k in got:
        # Exact duplicates cannot arise: k is a key.
        if present:
            assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)
        else:
            assert got[k] is None
    filled = dict(fill_numeric_median(df).select("k", "v").collect())
    assert all(v is not None for v in filled.values()) or not present
