"""Quality rules over the subscription fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.checks import (
    check_referential, check_required, referential_summary, repeated_values, rules_for,
    validation_report, validation_summary,
)
from ..settings import REQUIRED_COLUMNS
from .fixtures import MESSY_SQL, SUBSCRIPTIONS, messy, subscriptions, table
from .registry import query

_SUBS = f"with subs as ({SUBSCRIPTIONS})"
# A tenth of the amounts turned negative and some made extreme.
_SHIFTED = """case when subscription_id % 10 = 0 then -cast(mrr as double)
  when subscription_id % 33 = 0 then cast(mrr as double) * 100 else cast(mrr as double) end"""
_RULES = f"""{_SUBS}, shifted as (select {_SHIFTED} as mrr, churned,
    case when subscription_id % 40 = 0 then null else customer_id end as customer_id from subs),
  facts as (select count(case when mrr < 0 then 1 end) as neg,
    count(case when mrr > 1000000 then 1 end) as big, count(*) as rows,
    cast(count(case when churned then 1 end) as double) / count(*) as churn,
    cast(count(customer_id) as double) / count(*) as present,
    cast(count(distinct customer_id) as double) / count(*) as uniq from shifted),
  report as (
    select 'mrr_not_negative' as rule, 'mrr' as "column",
      case when neg = 0 then 'passed' else 'failure' end as outcome, cast(neg as double) as measure,
      concat(neg, ' values below 0') as detail from facts
    union all select 'mrr_not_extreme', 'mrr', case when big = 0 then 'passed' else 'warning' end,
      cast(big as double), concat(big, ' values above 1000000') from facts
    union all select 'churn_rate_valid', 'churned',
      case when churn <= 0.95 then 'passed' else 'warning' end, churn,
      concat('true ratio = ', printf('%.2f%%', churn * 100), ', max allowed = 95.00%') from facts
    union all select 'customer_id_not_null', 'customer_id',
      case when present >= 0.99 then 'passed' else 'failure' end, present,
      concat('not-null ratio = ', printf('%.2f%%', present * 100), ', required >= 99.00%') from facts
    union all select 'customer_id_unique', 'customer_id',
      case when uniq >= 0.9 then 'passed' else 'warning' end, uniq,
      concat('unique ratio = ', printf('%.2f%%', uniq * 100), ', required >= 90.00%') from facts)"""


def _shifted(spark, sf_dir):
    subs = subscriptions(spark, sf_dir, lines=False)
    key, mrr = F.col("subscription_id"), F.col("mrr").cast("double")
    return subs.select(
        F.when(key % 10 == 0, -mrr).when(key % 33 == 0, mrr * 100).otherwise(mrr).alias("mrr"),
        "churned", F.when(key % 40 != 0, F.col("customer_id")).alias("customer_id"))


def _one_rule(key: str, rule: str) -> None:
    @query(key, f"""{_RULES} select *, outcome <> 'failure' as passed from report
      where rule = '{rule}'""")
    def one(spark, sf_dir):
        rules = [r for r in rules_for("saas") if r.name == rule]
        return validation_report(_shifted(spark, sf_dir), rules=rules)


for _key, _rule in (
    ("check_min_value", "mrr_not_negative"), ("check_max_value", "mrr_not_extreme"),
    ("check_not_null_ratio", "customer_id_not_null"), ("check_unique_ratio", "customer_id_unique"),
    ("check_max_ratio_true", "churn_rate_valid"),
):
    _one_rule(_key, _rule)


@query("check_missing_column", f"""{_RULES} select rule, "column", 'warning' as outcome, true as passed,
  concat('Column ''', "column", ''' not present — skipped') as detail from report
  where "column" = 'customer_id'""")
def missing_column(spark, sf_dir):
    report = validation_report(_shifted(spark, sf_dir).drop("customer_id"))
    return report.filter("column = 'customer_id'").drop("measure")


@query("validation_report", f"{_RULES} select *, outcome <> 'failure' as passed from report")
def report(spark, sf_dir):
    return validation_report(_shifted(spark, sf_dir))


@query("validation_summary", f"""{_RULES} select count(case when outcome = 'failure' then 1 end) = 0
  as passed, count(*) as total_checks, count(case when outcome <> 'failure' then 1 end) as passed_checks,
  count(case when outcome = 'failure' then 1 end) as failed_checks,
  count(case when outcome = 'warning' then 1 end) as warnings,
  cast(count(case when outcome <> 'failure' then 1 end) as double) / count(*) as pass_rate
  from report""")
def summary(spark, sf_dir):
    return validation_summary(validation_report(_shifted(spark, sf_dir)))


@query("check_referential", """select o_custkey as key, count(*) as orphan_rows from orders
  where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')
  group by o_custkey""")
def referential(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return check_referential(table(spark, sf_dir, "orders"), "o_custkey", customers, "c_custkey")


@query("check_referential_summary", """select count(distinct l_orderkey) as missing_keys,
  count(*) as orphan_rows, count(*) = 0 as passed from lineitem
  where l_orderkey not in (select o_orderkey from orders)""")
def referential_totals(spark, sf_dir):
    return referential_summary(table(spark, sf_dir, "lineitem"), "l_orderkey",
                               table(spark, sf_dir, "orders"), "o_orderkey")


@query("check_required", f"""with m as ({MESSY_SQL})
  select 'customer_id' as "column", count(*) - count(customer_id) as nulls,
    count(customer_id) = count(*) as passed from m
  union all select 'plan', count(*), count(*) = 0 from m
  union all select 'mrr', count(*) - count(mrr), count(mrr) = count(*) from m
  union all select 'status', count(*), count(*) = 0 from m""")
def required(spark, sf_dir):
    return check_required(messy(spark, sf_dir), REQUIRED_COLUMNS["subscriptions"])


@query("check_unique", """select o_custkey as value, count(*) as copies from orders
  group by o_custkey having count(*) > 1""")
def unique(spark, sf_dir):
    return repeated_values(table(spark, sf_dir, "orders"), "o_custkey")
