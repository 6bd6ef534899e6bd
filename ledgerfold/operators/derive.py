"""Row-level revenue fields and the portfolio summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_timestamp, ref, round_scaled, whole_days
from ..settings import CHURNED_STATUSES, DAYS_PER_MONTH


def derive_arr(df: DataFrame) -> DataFrame:
    """Annual revenue; a table without monthly revenue gets zeros for both."""
    if "mrr" not in df.columns:
        return df.withColumns({"mrr": F.lit(0.0), "arr": F.lit(0.0)})
    return df.withColumn("arr", F.col("mrr") * F.lit(12))


def lifetime_months(start: Column, end: Column) -> Column:
    days = whole_days(start, end).cast("double")
    return round_scaled(days / F.lit(DAYS_PER_MONTH), 1)


def derive_lifetime(df: DataFrame) -> DataFrame:
    """Months from start to churn, null unless both dates are known."""
    if not {"start_date", "churn_date"} <= set(df.columns):
        return df
    dates = {c: as_timestamp(ref(c), df.schema[c].dataType) for c in ("start_date", "churn_date")}
    return df.withColumns(dates).withColumn(
        "lifetime_months", lifetime_months(F.col("start_date"), F.col("churn_date")))


def derive_churned(df: DataFrame) -> DataFrame:
    """Churn flag from the status text, where the table has no flag."""
    if "churned" in df.columns:
        return df
    if "status" not in df.columns:
        return df.withColumn("churned", F.lit(False))
    hit = F.lower(F.col("status")).isin(*CHURNED_STATUSES)
    return df.withColumn("churned", F.coalesce(hit, F.lit(False)))


def tag_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    return df.withColumn("dataset_id", F.lit(dataset_id))


def transform_subscriptions(df: DataFrame, dataset_id: str) -> DataFrame:
    """All row-level derivations."""
    return tag_dataset(derive_churned(derive_lifetime(derive_arr(df))), dataset_id)


def money_sum(value: Column, where: Column | None = None) -> Column:
    """Sum with zero for an empty selection; exact for decimals."""
    picked = value if where is None else F.when(where, value)
    total = F.sum(picked)
    return F.coalesce(total, F.lit(0).cast("int"))


def mean_of(total: Column, n: Column) -> Column:
    """Quotient of a sum and a count in double; null for an empty selection."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def portfolio_summary(df: DataFrame, start: str = "start_date") -> DataFrame:
    """One row of totals over the whole table, in one aggregate."""
    active, churned = ~F.col("churned"), F.col("churned")
    snapshots = F.lit(1).cast("bigint")
    months: list[Column] = []
    if start in df.columns:
        # Start months are few, whatever the table size.
        months = [F.count_distinct(F.trunc(ref(start), "month")).alias("months")]
        snapshots = F.greatest(F.col("months"), F.lit(1).cast("bigint"))
    totals = df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(active).alias("active_customers"),
        F.count_if(churned).alias("churned_customers"),
        money_sum(F.col("mrr"), active).alias("total_mrr"),
        F.sum(F.when(active, F.col("mrr"))).alias("active_sum"),
        F.count(F.when(active, F.col("mrr"))).alias("active_count"),
        *months,
    )
    return totals.select(
        "total_customers", "active_customers", "churned_customers", "total_mrr",
        (F.col("total_mrr") * F.lit(12)).alias("total_arr"),
        mean_of(F.col("churned_customers"), F.col("total_customers")).alias("churn_rate"),
        F.coalesce(mean_of(F.col("active_sum"), F.col("active_count")), F.lit(0.0))
        .alias("avg_mrr_per_customer"),
        snapshots.alias("monthly_snapshots"),
    )


def is_decimal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DecimalType, T.IntegralType))
