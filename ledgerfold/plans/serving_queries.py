"""Serving queries, business questions and operational rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paging import nth_page
from ..functions.scratch import stage
from ..operators import serving
from ..operators.derive import derive_arr, derive_lifetime
from ..operators.enrich import churn_reason_category
from ..operators.outliers import anomalies
from ..operators.snapshot import monthly_snapshot
from ..settings import ETL_BOUNDS_SECONDS, LATENCY_BOUNDS_MS
from ..sources.store import newest
from .enrich_queries import REASON_SQL
from .fixtures import (
    DATASET_LOG, JOB_LOG, LIFETIME, QUERY_LOG, REPORT_LOG, SUBSCRIPTIONS, anomalies_sql,
    as_doubles, from_events, metrics_ctes, newest_sql, report_log, subscriptions, table,
)
from .registry import query

_SUBS = f"""with subs as ({SUBSCRIPTIONS}),
  labelled as (select *, {REASON_SQL} as churn_reason_category from subs)"""
_METRICS = f"with {metrics_ctes()}"
_CELLS = anomalies_sql("events", "event_id", ("value",))
_FIELDS = ("period", "mrr", "new_mrr", "churned_mrr", "net_new_mrr", "active_customers",
           "churn_rate", "nrr", "arpu")


def _labelled(spark, sf_dir, lines=False):
    subs = subscriptions(spark, sf_dir, lines=lines)
    return subs.withColumn("churn_reason_category", churn_reason_category(F.col("churn_reason")))


def _metrics(spark, sf_dir):
    return as_doubles(monthly_snapshot(subscriptions(spark, sf_dir)))


def _cells(spark, sf_dir):
    return anomalies(table(spark, sf_dir, "events"), keep=("event_id",), columns=["value"],
                     context=["event_id"])


# --- Anomalies ----------------------------------------------------------------

@query("anomaly_top", f"""with cells as ({_CELLS}), top as (select * from cells
    order by score desc, column_name, row_key limit 50)
  select row_key as event_id, column_name, method, value, round(score, 4) as score, severity,
    (select count(*) from cells) as total from top""")
def anomaly_top(spark, sf_dir):
    return serving.anomaly_top(_cells(spark, sf_dir), "event_id").select(
        "event_id", "column_name", "method", "value", "score", "severity", "total")


@query("anomaly_top_severity", f"""with cells as (select * from ({_CELLS})
    where severity = 'medium'), top as (select * from cells order by score desc, row_key limit 50)
  select row_key as event_id, value, round(score, 4) as score,
    (select count(*) from cells) as total from top""")
def anomaly_top_severity(spark, sf_dir):
    return serving.anomaly_top(_cells(spark, sf_dir), "event_id", severity="medium").select(
        "event_id", "value", "score", "total")


@query("anomaly_pages", f"""with cells as ({_CELLS}), top as (select *, row_number() over (
    order by score desc, column_name, row_key) as place from cells)
  select row_key as event_id, column_name, value, score from top where place > 40 and place <= 60""")
def anomaly_pages(spark, sf_dir):
    """The third page of twenty, each found behind the last row of the one before."""
    cells = stage(_cells(spark, sf_dir), "cells")
    read = lambda cursor: serving.anomaly_page(cells, "event_id", limit=20, cursor=cursor)
    return nth_page(read, serving.anomaly_order("event_id"), 20, 2).select("event_id", "column_name", "value", "score")


@query("severity_counts", f"""select count(case when severity = 'high' then 1 end) as high,
  count(case when severity = 'medium' then 1 end) as medium,
  count(case when severity = 'low' then 1 end) as low from ({_CELLS})""")
def severity_counts(spark, sf_dir):
    return serving.severity_counts(_cells(spark, sf_dir))


_TOP_CELLS = f"""select row_key as event_id, column_name, severity, value, score,
  concat('- [', upper(severity), '] ', column_name, ': value=', printf('%.2f', value),
    ' | No explanation') as line
  from ({_CELLS}) where severity in ('medium', 'high') order by score desc, column_name, row_key limit 3"""


@query("top_anomalies", f"select * replace (round(score, 4) as score) from ({_TOP_CELLS})")
def top_anomalies(spark, sf_dir):
    top = serving.top_anomalies(_cells(spark, sf_dir), "event_id")
    return top.withColumn("score", F.round("score", 4))


# --- Metrics ------------------------------------------------------------------

@query("metrics_first_n", f"""{_METRICS} select {', '.join(_FIELDS)} from metrics
  order by period limit 12""")
def metrics_first_n(spark, sf_dir):
    return serving.metrics_first_n(_metrics(spark, sf_dir)).select(*_FIELDS)


_TREND_LINE = """concat(period, ' | $', format('{:,.0f}', mrr), ' | ',
  printf('%.1f%%', churn_rate * 100), ' | ', active_customers)"""


@query("metrics_last_n", f"""{_METRICS} select {', '.join(_FIELDS)}, {_TREND_LINE} as line
  from (select * from metrics order by period desc limit 6)""")
def metrics_last_n(spark, sf_dir):
    return serving.metrics_last_n(_metrics(spark, sf_dir)).select(*_FIELDS, "line")


@query("latest_metrics", f"""{_METRICS} select {', '.join(_FIELDS)} from metrics
  order by period desc limit 1""")
def latest_metrics(spark, sf_dir):
    return serving.latest_metrics(_metrics(spark, sf_dir)).select(*_FIELDS)


@query("mrr_waterfall", f"""{_METRICS} select concat(period, '-01') as month, new_mrr,
  -churned_mrr as lost_mrr, mrr as total_mrr, churn_rate * 100 as churn_percent, new_customers,
  -churned_customers as lost_customers, active_customers from metrics""")
def mrr_waterfall(spark, sf_dir):
    chart = serving.mrr_waterfall(_metrics(spark, sf_dir))
    return chart.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query("dashboard_summary", f"""with {metrics_ctes(by=True)},
  cells as (select n_name as dataset_id, severity from ({_CELLS}) join nation
    on row_key % 25 = n_nationkey),
  latest as (select * from (select *, row_number() over (partition by dataset_id
    order by period desc) as rn from metrics) where rn = 1)
  select n_name as dataset_id, concat('set ', n_name) as dataset_name, 'ready' as status,
    (select count(*) from customer where c_nationkey = n_nationkey) as row_count,
    period as latest_period, coalesce(mrr, 0) as mrr, coalesce(active_customers, 0) as active_customers,
    coalesce(churn_rate, 0) as churn_rate, coalesce(net_new_mrr, 0) as net_new_mrr,
    (select count(*) from cells c where c.dataset_id = n_name and severity = 'high') as high_anomalies,
    (select count(*) from cells c where c.dataset_id = n_name and severity = 'medium') as medium_anomalies,
    (select count(*) from cells c where c.dataset_id = n_name and severity = 'low') as low_anomalies
  from nation left join latest on dataset_id = n_name""")
def dashboard_summary(spark, sf_dir):
    """One dataset per country; events are dealt out to the countries."""
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("row_count"))
    datasets = nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("dataset_id"),
        F.concat(F.lit("set "), "n_name").alias("dataset_name"), F.lit("ready").alias("status"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"))
    subs = subscriptions(spark, sf_dir).withColumn("dataset_id", F.col("country"))
    metrics = as_doubles(monthly_snapshot(subs, by=("dataset_id",)))
    cells = _cells(spark, sf_dir).join(nation, F.col("event_id") % 25 == F.col("n_nationkey")).select(
        F.col("n_name").alias("dataset_id"), "severity")
    return serving.dashboard_summary(datasets, metrics, cells)


# --- Report -------------------------------------------------------------------

_TOP_CHURNED = """select subscription_id, coalesce(nullif(customer_name, ''), customer_id) as customer,
  cast(mrr as double) as mrr, plan, coalesce(churn_reason_category, 'unknown') as reason,
  concat('- ', customer_name, ': $', format('{:,.0f}', cast(mrr as double)), ' MRR | ', plan,
    ' | reason: ', coalesce(churn_reason_category, 'unknown')) as line
  from labelled where churned order by labelled.mrr desc, subscription_id limit 5"""


@query("top_churned", f"{_SUBS} {_TOP_CHURNED}")
def top_churned(spark, sf_dir):
    return as_doubles(serving.top_churned(_labelled(spark, sf_dir), "subscription_id"))


_CONTEXT = f"""{_METRICS}, labelled as (select *, {REASON_SQL} as churn_reason_category from subs),
  latest as (select * from metrics order by period desc limit 1),
  context as (select '2024-06' as period, {', '.join(f'(select {c} from latest) as latest_{c}' for c in _FIELDS)},
    concat('period | MRR | churn_rate | active_customers', chr(10),
      (select string_agg({_TREND_LINE}, chr(10) order by period)
       from (select * from metrics order by period desc limit 6))) as trend,
    (select string_agg(line, chr(10) order by mrr desc, subscription_id) from ({_TOP_CHURNED}))
      as churned_customers,
    (select string_agg(line, chr(10) order by score desc, event_id) from ({_TOP_CELLS})) as anomalies)"""


def _context(spark, sf_dir):
    return serving.report_context(
        _labelled(spark, sf_dir), _metrics(spark, sf_dir), _cells(spark, sf_dir),
        "subscription_id", "event_id", "2024-06")


@query("report_context", f"{_CONTEXT} select * from context")
def report_context(spark, sf_dir):
    return _context(spark, sf_dir).select(
        "period", *_numbers(F.col("metrics")), "trend", "churned_customers", "anomalies")


def _numbers(text):
    """The fields of a JSON text of metrics."""
    types = {"period": "string", "active_customers": "bigint"}
    return [F.get_json_object(text, f"$.{c}").cast(types.get(c, "double")).alias(f"latest_{c}") for c in _FIELDS]


@query("report_markdown", f"""{_CONTEXT} select period, {', '.join(f'latest_{c}' for c in _FIELDS)},
  concat('# Subscription report 2024-06', chr(10), chr(10), '## Key metrics', chr(10), chr(10), '```json', chr(10),
  chr(10), '```', chr(10), chr(10), '## Monthly trend', chr(10), chr(10),
  trend, chr(10), chr(10), '## Top churned customers', chr(10), chr(10), churned_customers, chr(10),
  chr(10), '## Anomalies', chr(10), chr(10), anomalies) as text from context""")
def report_markdown(spark, sf_dir):
    """The whole document: its JSON as numbers, and all the text around it."""
    whole = serving.report_markdown(_context(spark, sf_dir))
    json = "```json\n([^\n]*)\n```"
    return whole.select(
        "period", *_numbers(F.regexp_extract("markdown", json, 1)),
        F.regexp_replace("markdown", json, "```json\n\n```").alias("text"))


# --- Logs ---------------------------------------------------------------------

def _histogram_sql(value: str, bounds: tuple[int, ...]) -> str:
    parts = [f"select '{b}' as le, count(case when {value} <= {b} then 1 end) as observations from events"
             for b in bounds]
    return " union all ".join([*parts, f"select '+Inf', count({value}) from events"])


@query("latency_histogram", _histogram_sql("value * 10", LATENCY_BOUNDS_MS))
def latency_histogram(spark, sf_dir):
    return serving.histogram(from_events(spark, sf_dir, QUERY_LOG), "latency_ms", LATENCY_BOUNDS_MS)


@query("etl_histogram", _histogram_sql(
    "(case when event_type <> 'error' then floor(value) end)", ETL_BOUNDS_SECONDS))
def etl_histogram(spark, sf_dir):
    """Durations of a job log in which failed jobs never finish."""
    started = F.col("ts").cast("timestamp_ntz")
    jobs = table(spark, sf_dir, "events").select(started.alias("started_at"), F.when(
        F.col("event_type") != "error", F.timestamp_add("SECOND", F.floor("value").cast("int"), started)).alias("finished_at"))
    return serving.histogram(serving.job_seconds(jobs), "seconds", ETL_BOUNDS_SECONDS)


@query("ops_counters", f"""with datasets as ({newest_sql(DATASET_LOG)}), jobs as ({newest_sql(JOB_LOG)}),
  queries as ({QUERY_LOG.format(events='events')}), cells as ({_CELLS}),
  reports as ({REPORT_LOG.format(documents='documents')})
  select 'datasets_ingested' as metric, source_type as label, count(*) as value
    from datasets group by source_type
  union all select 'etl_errors', stage, count(*) from jobs where status = 'failed' group by stage
  union all select 'queries', case when success then 'success' else 'error' end, count(*)
    from queries group by success
  union all select 'anomalies_detected', severity, count(*) from cells group by severity
  union all select 'reports_generated', form, count(*) from (select case when pdf_path is not null
    then 'pdf' else 'markdown' end as form from reports) group by form
  union all select 'rows_processed', '', cast(sum(rows_processed) as bigint) from jobs
  union all select 'rows_enriched', '', cast(sum(rows_enriched) as bigint) from jobs""")
def ops_counters(spark, sf_dir):
    return serving.ops_counters(
        newest(from_events(spark, sf_dir, DATASET_LOG)), newest(from_events(spark, sf_dir, JOB_LOG)),
        from_events(spark, sf_dir, QUERY_LOG), _cells(spark, sf_dir), report_log(spark, sf_dir))


# --- Business questions --------------------------------------------------------

@query("q_total_active_mrr", f"""{_SUBS} select cast(sum(mrr) as double) as total_mrr,
  count(*) as active_customers from subs where not churned""")
def q_total_active_mrr(spark, sf_dir):
    return as_doubles(serving.total_active_mrr(subscriptions(spark, sf_dir, lines=False)))


_PLAN_CHURN = """select plan, cast(count(case when churned then 1 end) as double)
  / cast(count(*) as double) as churn_rate from subs group by plan"""


@query("q_plan_churn", f"{_SUBS} {_PLAN_CHURN} order by churn_rate desc, plan limit 1")
def q_plan_churn(spark, sf_dir):
    return serving.highest_plan_churn(subscriptions(spark, sf_dir, lines=False))


@query("q_plan_churn_all", f"{_SUBS} {_PLAN_CHURN}")
def q_plan_churn_all(spark, sf_dir):
    return serving.plan_churn(subscriptions(spark, sf_dir, lines=False))


@query("q_top_customers", f"""{_SUBS} select subscription_id, customer_id, customer_name, plan,
  cast(mrr as double) as mrr from subs order by subs.mrr desc, subscription_id limit 5""")
def q_top_customers(spark, sf_dir):
    return as_doubles(serving.top_customers(subscriptions(spark, sf_dir, lines=False), "subscription_id"))


@query("q_price_churn_share", f"""{_SUBS} select count(*) as churned,
  count(case when churn_reason_category = 'price' then 1 end) as matching,
  cast(count(case when churn_reason_category = 'price' then 1 end) as double)
    / cast(count(*) as double) * 100 as percent from labelled where churned""")
def q_price_churn_share(spark, sf_dir):
    return serving.churn_share(_labelled(spark, sf_dir), "price")


_MEAN = f"""select count(m) as customers, cast(cast(sum(round(m * 10)) as bigint) as double)
  / (cast(count(m) as double) * 10) as mean_lifetime_months
  from (select {LIFETIME} as m, plan, churned from subs)"""


@query("q_plan_lifetime", f"{_SUBS} {_MEAN} where plan = '1-URGENT'")
def q_plan_lifetime(spark, sf_dir):
    subs = derive_lifetime(subscriptions(spark, sf_dir))
    return serving.mean_lifetime(subs, plan="1-URGENT")


@query("q_country_active", f"""{_SUBS} select country, count(*) as active_customers from subs
  where not churned group by country order by active_customers desc, country limit 1""")
def q_country_active(spark, sf_dir):
    return serving.country_active(subscriptions(spark, sf_dir, lines=False))


@query("q_mrr_trend", f"{_METRICS} select period, mrr from metrics order by period desc limit 6")
def q_mrr_trend(spark, sf_dir):
    return serving.metrics_last_n(_metrics(spark, sf_dir)).select("period", "mrr")


@query("q_churned_lifetime", f"{_SUBS} {_MEAN} where churned")
def q_churned_lifetime(spark, sf_dir):
    return serving.mean_lifetime(derive_lifetime(subscriptions(spark, sf_dir)), churned_only=True)


@query("q_plan_monthly_churn", "with " + metrics_ctes(where="plan = '2-HIGH'") + """
  select period, active_customers, churned_customers, churn_rate from metrics""")
def q_plan_monthly_churn(spark, sf_dir):
    return serving.plan_monthly_churn(subscriptions(spark, sf_dir), "2-HIGH")


@query("q_plan_avg_mrr_active", f"""{_SUBS} select plan,
  cast(sum(mrr) as double) / cast(count(mrr) as double) as avg_mrr
  from subs where not churned group by plan""")
def q_plan_avg_mrr_active(spark, sf_dir):
    return serving.plan_avg_mrr_active(subscriptions(spark, sf_dir, lines=False))


_GIVEN = """select s.country, count(*) as customers, cast(sum(s.arr) as double) as arr
  from saas_subscriptions s where s.plan ilike '%high%' group by s.country
  having count(*) >= 1"""


@query("safe_sql", f"""{_SUBS}, saas_subscriptions as (select *, mrr * 12 as arr from subs) {_GIVEN}""")
def safe_sql(spark, sf_dir):
    """A given statement with code fences, over the named table."""
    subs = derive_arr(subscriptions(spark, sf_dir, lines=False))
    return serving.safe_sql(spark, f"```sql\n{_GIVEN}\n```", {"saas_subscriptions": subs})


_SHADOWED = """WITH customer_plans AS (SELECT plan, mrr FROM saas_subscriptions WHERE NOT churned),
  saas_metrics AS (SELECT plan, COUNT(*) AS customers, SUM(mrr) AS mrr FROM customer_plans GROUP BY plan)
SELECT plan, customers, CAST(mrr AS DOUBLE) AS mrr FROM saas_metrics
WHERE plan IN (SELECT plan FROM saas_subscriptions GROUP BY plan HAVING COUNT(*) > 1)"""


@query("safe_sql_shadowed", f"""{_SUBS}, saas_subscriptions as (select * from subs)
  select * from ({_SHADOWED})""")
def safe_sql_shadowed(spark, sf_dir):
    """A statement whose own name is that of a stored table it doesn't read."""
    subs = subscriptions(spark, sf_dir, lines=False)
    return serving.safe_sql(spark, _SHADOWED, {"saas_subscriptions": subs, "saas_metrics": subs})
