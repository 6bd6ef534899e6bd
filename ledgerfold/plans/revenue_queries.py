"""Revenue derivations, snapshots and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.derive import (
    derive_arr, derive_churned, derive_lifetime, portfolio_summary, tag_dataset,
)
from ..operators.snapshot import month_period, monthly_snapshot, single_snapshot
from .fixtures import LIFETIME, SUBSCRIPTIONS, as_doubles, metrics_ctes, subscriptions
from .registry import query

_SUBS = f"with subs as ({SUBSCRIPTIONS})"
_METRICS = f"with {metrics_ctes()}"


@query("derive_arr", f"""{_SUBS} select subscription_id, cast(mrr as double) as mrr,
  cast(mrr * 12 as double) as arr from subs""")
def arr(spark, sf_dir):
    subs = subscriptions(spark, sf_dir, lines=False).select("subscription_id", "mrr")
    return as_doubles(derive_arr(subs))


@query("derive_lifetime", f"{_SUBS} select subscription_id, {LIFETIME} as lifetime_months from subs")
def lifetime(spark, sf_dir):
    return derive_lifetime(subscriptions(spark, sf_dir)).select("subscription_id", "lifetime_months")


@query("derive_churned", f"""{_SUBS} select subscription_id, status,
  lower(status) in ('churned', 'cancelled', 'canceled') as churned from subs""")
def churned(spark, sf_dir):
    subs = subscriptions(spark, sf_dir, lines=False).select("subscription_id", "status")
    return derive_churned(subs)


@query("tag_dataset", f"{_SUBS} select subscription_id, 'ds_1' as dataset_id from subs")
def tag(spark, sf_dir):
    return tag_dataset(subscriptions(spark, sf_dir, lines=False).select("subscription_id"), "ds_1")


@query("portfolio_summary", f"""{_SUBS} select count(*) as total_customers,
  count(case when not churned then 1 end) as active_customers,
  count(case when churned then 1 end) as churned_customers,
  cast(sum(case when not churned then mrr end) as double) as total_mrr,
  cast(sum(case when not churned then mrr * 12 end) as double) as total_arr,
  cast(count(case when churned then 1 end) as double) / cast(count(*) as double) as churn_rate,
  cast(sum(case when not churned then mrr end) as double)
    / cast(count(case when not churned then 1 end) as double) as avg_mrr_per_customer,
  count(distinct date_trunc('month', start_date)) as monthly_snapshots from subs""")
def summary(spark, sf_dir):
    return as_doubles(portfolio_summary(subscriptions(spark, sf_dir, lines=False)))


@query("month_period", f"""{_SUBS} select distinct strftime(start_date, '%Y-%m') as period
  from subs where start_date is not null""")
def periods(spark, sf_dir):
    return month_period(subscriptions(spark, sf_dir, lines=False))


@query("monthly_snapshot", f"{_METRICS} select * from metrics")
def snapshot(spark, sf_dir):
    return as_doubles(monthly_snapshot(subscriptions(spark, sf_dir)))


@query("monthly_snapshot_interval", f"{_METRICS} select * from metrics")
def snapshot_interval(spark, sf_dir):
    return as_doubles(monthly_snapshot(subscriptions(spark, sf_dir), form="interval"))


@query("monthly_snapshot_by_dataset", f"with {metrics_ctes(by=True)} select * from metrics")
def snapshot_by(spark, sf_dir):
    subs = subscriptions(spark, sf_dir).withColumn("dataset_id", F.col("country"))
    return as_doubles(monthly_snapshot(subs, by=("dataset_id",)))


def _measure(name: str) -> None:
    """Each measure of the snapshot under its own name."""

    @query(f"snapshot_{name}", f"{_METRICS} select period, {name} from metrics")
    def one(spark, sf_dir):
        months = monthly_snapshot(subscriptions(spark, sf_dir))
        return as_doubles(months.select("period", name))


for _name in ("mrr", "new_mrr", "expansion_mrr", "churned_mrr", "net_new_mrr", "active_customers",
              "new_customers", "churned_customers", "churn_rate", "arpu", "nrr"):
    _measure(_name)


@query("single_snapshot", f"""{_SUBS} select '2024-01' as period,
  cast(sum(case when not churned then mrr end) as double) as mrr,
  cast(sum(case when not churned then mrr end) as double) as new_mrr,
  cast(0 as double) as expansion_mrr,
  cast(sum(case when churned then mrr end) as double) as churned_mrr,
  cast(sum(case when churned then -mrr else mrr end) as double) as net_new_mrr,
  count(case when not churned then 1 end) as active_customers, count(*) as new_customers,
  count(case when churned then 1 end) as churned_customers,
  cast(count(case when churned then 1 end) as double) / cast(count(*) as double) as churn_rate,
  cast(sum(case when not churned then mrr end) as double)
    / cast(count(case when not churned then 1 end) as double) as arpu from subs""")
def single(spark, sf_dir):
    subs = subscriptions(spark, sf_dir, lines=False).drop("start_date")
    return as_doubles(single_snapshot(subs, month="2024-01"))


@query("snapshot_infinite", f"""with subs as ({SUBSCRIPTIONS}),
  spans as (select *, date_trunc('month', start_date) as s, date_trunc('month', churn_date) as c,
    case when subscription_id % 997 = 0 then 'inf'::double when subscription_id % 3001 = 0 then '-inf'::double end as endless
    from subs),
  months as (select distinct s as m from spans),
  sums as (select m, s <= m and (c is null or c > m) as is_active, s = m as is_new, mrr, endless
    from months join spans on s <= m or c = m),
  totals as (select strftime(m, '%Y-%m') as period, count(case when is_active then 1 end) as active_customers,
    coalesce(sum(case when is_active then endless end), sum(case when is_active and endless is null then mrr else 0 end)::double) as mrr,
    coalesce(sum(case when is_new then endless end), sum(case when is_new and endless is null then mrr else 0 end)::double) as new_mrr
    from sums group by m)
  select period, active_customers, case when isfinite(mrr) then mrr end as mrr, case when isfinite(new_mrr) then new_mrr end as new_mrr,
    case when isfinite(mrr) then 'finite' when isnan(mrr) then 'none' when mrr > 0 then 'above' else 'below' end as kind from totals""")
def snapshot_infinite(spark, sf_dir):
    """Floating amounts some of which are infinite: the months in which these count are, too."""
    key = F.col("subscription_id")
    subs = subscriptions(spark, sf_dir).withColumn("mrr", F.when(key % 997 == 0, float("inf")).when(
        key % 3001 == 0, float("-inf")).otherwise(F.col("mrr").cast("double")))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    mrr = F.col("mrr")
    kind = F.when(F.isnan(mrr), "none").when(mrr == float("inf"), "above").when(mrr == float("-inf"), "below").otherwise("finite")
    return monthly_snapshot(subs).select("period", "active_customers", finite("mrr"), finite("new_mrr"), kind.alias("kind"))
