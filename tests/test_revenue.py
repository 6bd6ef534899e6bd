import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators.derive import (
    derive_arr, derive_churned, derive_lifetime, portfolio_summary, tag_dataset, transform_subscriptions,
)
from ledgerfold.operators.snapshot import MEASURES, month_period, monthly_snapshot, single_snapshot, snapshots


def d(text):
    return datetime.fromisoformat(text) if text else None


SCHEMA = ("customer_id string, mrr double, churned boolean, status string, start_date timestamp_ntz, "
          "churn_date timestamp_ntz, plan string, country string")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([
        ("c1", 100.0, False, "active", d("2023-01-01"), None, "starter", "US"),
        ("c2", 200.0, False, "active", d("2023-02-01"), None, "growth", "BR"),
        ("c3", 300.0, True, "churned", d("2023-01-15"), d("2023-06-01"), "starter", "US"),
        ("c4", 400.0, True, "churned", d("2023-03-01"), d("2023-07-01"), "professional", "DE"),
    ], SCHEMA)


def test_row_level_fields(sample):
    rows = {r["customer_id"]: r for r in transform_subscriptions(sample, "ds_9").collect()}
    assert all(r["arr"] == r["mrr"] * 12 and r["dataset_id"] == "ds_9" for r in rows.values())
    assert rows["c1"]["lifetime_months"] is None
    assert rows["c3"]["lifetime_months"] == round(137 / 30.44, 1)


@pytest.mark.parametrize("form", ["running", "interval"])
def test_worked_snapshot(sample, form):
    rows = monthly_snapshot(sample, form=form).orderBy("period").collect()
    assert [tuple(r[c] for c in ("period", "mrr", "new_mrr", "churned_mrr", "active_customers",
                                 "new_customers", "churned_customers", "churn_rate", "arpu", "nrr"))
            for r in rows] == [
        ("2023-01", 400, 400, 0, 2, 2, 0, 0.0, 200.0, 40000.0),
        ("2023-02", 600, 200, 0, 3, 1, 0, 0.0, 200.0, 150.0),
        ("2023-03", 1000, 400, 0, 4, 1, 0, 0.0, 250.0, 166.67),
    ]


def test_lifetime_counts_whole_days(spark):
    df = spark.createDataFrame([
        (d("2023-01-01T23:00"), d("2023-01-02T01:00")), (d("2023-01-02T01:00"), d("2023-01-01T23:00")),
        (d("2023-01-01"), d("2024-01-01")), (None, d("2024-01-01")),
    ], "start_date timestamp_ntz, churn_date timestamp_ntz")
    assert [r[0] for r in derive_lifetime(df).select("lifetime_months").collect()] == [
        0.0, -0.0, 12.0, None]


def test_churned_from_status(spark):
    df = spark.createDataFrame([("Churned",), ("CANCELED",), ("cancelled",), ("active",), (None,)],
                               "status string")
    assert [r[1] for r in derive_churned(df).collect()] == [True, True, True, False, False]
    assert not any(r[1] for r in derive_churned(df.withColumnRenamed("status", "s")).collect())


def test_no_revenue_column(spark):
    df = tag_dataset(derive_arr(spark.range(2)), "x")
    assert df.select("mrr", "arr").distinct().collect() == [(0.0, 0.0)]


def test_summary(sample):
    row = portfolio_summary(derive_arr(sample)).first().asDict()
    assert row == {
        "total_customers": 4, "active_customers": 2, "churned_customers": 2, "total_mrr": 300.0,
        "total_arr": 3600.0, "churn_rate": 0.5, "avg_mrr_per_customer": 150.0, "monthly_snapshots": 3}


def test_summary_of_an_empty_table(sample):
    row = portfolio_summary(sample.limit(0)).first()
    assert row["total_customers"] == 0 and row["total_mrr"] == 0 and row["churn_rate"] is None


def _random_rows(seed, n=400):
    rng = random.Random(seed)
    base = datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        start = base + timedelta(days=rng.randrange(900)) if rng.random() > 0.05 else None
        churn = base + timedelta(days=rng.randrange(1200)) if rng.random() > 0.5 else None
        rows.append((f"c{i}", float(rng.randrange(1, 1000)) / 4, churn is not None, "s", start, churn,
                     rng.choice("ab"), rng.choice(["US", "US", "US", "BR"])))
    return rows


def _brute(rows):
    """Straight from the definition, month by month."""
    def month(t):
        return (t.year, t.month) if t else None

    result = {}
    for p in sorted({month(r[4]) for r in rows if r[4]}):
        active = [r for r in rows if r[4] and month(r[4]) <= p and (r[5] is None or month(r[5]) > p)]
        new = [r for r in rows if month(r[4]) == p]
        gone = [r for r in rows if month(r[5]) == p]
        mrr, new_v, gone_v = (sum(r[1] for r in part) for part in (active, new, gone))
        result["%04d-%02d" % p] = {
            "mrr": mrr, "new_mrr": new_v, "expansion_mrr": 0.0, "churned_mrr": gone_v,
            "net_new_mrr": new_v - gone_v, "active_customers": len(active),
            "new_customers": len(new), "churned_customers": len(gone),
            "churn_rate": round(len(gone) / max(len(active), 1), 4),
            "arpu": round(mrr / max(len(active), 1), 2),
            "nrr": round(mrr / max(mrr - new_v + gone_v, 1) * 100, 2)}
    return result


@pytest.mark.parametrize("form", ["running", "interval"])
def test_snapshot_against_brute_force(spark, form):
    """Null starts, churn before start, gaps: both forms follow the definition."""
    rows = _random_rows(5)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mrr", F.col("mrr").cast("decimal(12,2)"))
    got = {r["period"]: {m: float(r[m]) for m in MEASURES} for r in monthly_snapshot(df, form=form).collect()}
    assert got == {p: {m: float(v) for m, v in r.items()} for p, r in _brute(rows).items()}


@pytest.mark.parametrize("form", ["running", "interval"])
def test_snapshot_per_dataset(spark, form):
    rows = _random_rows(6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["country"], r["period"]): r["active_customers"]
           for r in monthly_snapshot(df, by=("country",), form=form).collect()}
    want = {(c, p): m["active_customers"] for c in ("US", "BR")
            for p, m in _brute([r for r in rows if r[7] == c]).items()}
    assert got == want


def test_periods_have_no_gap_fill(sample):
    extra = sample.filter("customer_id <> 'c2'")
    assert sorted(r[0] for r in month_period(extra).collect()) == ["2023-01", "2023-03"]


def test_single_snapshot_without_dates(sample):
    bare = sample.drop("start_date")
    row = single_snapshot(bare, "2024-05").first()
    assert (row["period"], row["mrr"], row["new_mrr"], row["churned_mrr"], row["net_new_mrr"]) == (
        "2024-05", 300.0, 300.0, 700.0, -400.0)
    assert (row["new_customers"], row["churn_rate"], row["arpu"]) == (4, 0.5, 150.0)
    nulls = sample.withColumn("start_date", F.lit(None).cast("timestamp_ntz"))
    assert snapshots(nulls, "2024-05").first()["nrr"] is None
    assert snapshots(sample).count() == 3


def test_rounding_follows_the_binary_value(spark):
    from ledgerfold.functions.columns import round_exact, round_scaled
    values = [2.675, 0.125, 0.375, -1.005, 1234567.895, 0.03125, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_exact(F.col("x"), 2)).collect()]
    assert got == [round(v, 2) if v not in (None, float("inf")) else v for v in values]
    import numpy as np
    got = [r[0] for r in df.filter("x < 1e9").select(round_scaled(F.col("x"), 1)).collect()]
    assert got == [float(np.round(v, 1)) for v in values[:6]]
