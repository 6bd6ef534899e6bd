"""The whole sequence from a landed file to stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_path
from ..sources import Store
from ..sources.readers import ROW_INDEX, land_source
from .clean_queries import _fence
from .enrich_queries import INDUSTRY_SQL, PLAN_SQL, REASON_SQL, RISK_SQL
from .etl import run_etl, write_months
from .fixtures import LIFETIME, SUBSCRIPTIONS, anomalies_sql, as_doubles, metrics_ctes, subscriptions, table
from .increments import append_subscriptions, remove_subscriptions
from .registry import query
from .service import answer

# The subscription fixture as an export would bring it, run through the stages.
_READY = f"""with subs as ({SUBSCRIPTIONS}),
  filled as (select * replace (cast(mrr as double) as mrr,
    coalesce(seats, (select quantile_cont(seats, 0.5) from subs)) as seats) from subs),
  capped as (select * replace (greatest(least(mrr, m_hi), m_lo) as mrr,
    greatest(least(seats, s_hi), s_lo) as seats) from filled,
    (select lo as m_lo, hi as m_hi from {_fence('mrr', 'filled')}),
    (select lo as s_lo, hi as s_hi from {_fence('seats', 'filled')})),
  derived as (select *, mrr * 12 as arr, {LIFETIME} as lifetime_months from capped),
  ready as (select *, {RISK_SQL} as churn_risk_score from derived)"""
_CELLS = anomalies_sql("ready", "subscription_id",
                       ("mrr", "seats", "arr", "lifetime_months", "churn_risk_score"))


def _in_files(df, files, *order):
    """The rows in order, over that many files, or as many as the session has partitions if these are more."""
    files = max(files, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def _run(spark, sf_dir, **options):
    path = new_path(spark, "export")
    subs = subscriptions(spark, sf_dir).withColumn(
        "churned", F.initcap(F.col("churned").cast("string")))
    subs = subs.withColumnsRenamed({"mrr": "Monthly Revenue", "plan": "Tier"})
    subs.write.option("header", True).csv(path)
    store = Store(spark, new_path(spark, "store"))
    run = run_etl(spark, store, "orders", "csv", path=path, key=("subscription_id",), **options)
    return run, store


@query("etl_result", f"""{_READY} select 'orders' as dataset_id, (select count(*) from subs) as
  rows_processed, (select count(*) from ready) as rows_final,
  (select count(*) from ({_CELLS})) as anomalies_found, (select count(*) filter (mrr < 0) = 0 and count(customer_id) >= 0.99 * count(*) from ready) as validation_passed,
  'completed' as status""")
def etl_result(spark, sf_dir):
    run, _ = _run(spark, sf_dir)
    return run.as_frame(spark)


@query("run_etl", f"""{_READY} select customer_id, customer_name, plan, {PLAN_SQL} as plan_category, status, churned,
  country, industry, {INDUSTRY_SQL} as industry_category, coalesce(churn_reason, 'unknown') as churn_reason,
  {REASON_SQL} as churn_reason_category, round(mrr, 2) as mrr, round(arr, 2) as arr, lifetime_months,
  churn_risk_score, strftime(start_date, '%Y-%m-%d') as start_date, strftime(churn_date, '%Y-%m-%d') as churn_date,
  cast(floor(seats) as bigint) as seats from ready""")
def stored_rows(spark, sf_dir):
    _, store = _run(spark, sf_dir)
    return as_doubles(store.table("subscriptions").select(
        "customer_id", "customer_name", "plan", "plan_category", "status", "churned", "country", "industry",
        "industry_category", "churn_reason", "churn_reason_category", "mrr", "arr", "lifetime_months",
        "churn_risk_score", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("churn_date", "yyyy-MM-dd").alias("churn_date"), "seats"))


@query("run_etl_with_model", f"""{_READY} select customer_id, coalesce(churn_reason, 'unknown') as churn_reason,
  case when churn_reason <> 'unknown' and length(churn_reason) > 3 then 'usage' end as churn_reason_category,
  churn_risk_score from ready""")
def run_with_model(spark, sf_dir):
    """A run in which a model labels the reasons and explains the anomalies; the rules label the rest."""
    _, store = _run(
        spark, sf_dir, models={"churn_reason_category": lambda: lambda ps: ['{"category": "usage"}' for _ in ps]},
        explain=lambda: lambda ps: ["expected" for _ in ps])
    return store.table("subscriptions").select(
        "customer_id", "churn_reason", "churn_reason_category", "churn_risk_score")


@query("explain_anomalies", f"""{_READY} select 'explained ' || column_name as llm_explanation, count(*) as cells
  from ({_CELLS}) group by column_name""")
def explained(spark, sf_dir):
    """The stored explanations of a run, by the column that their prompts name."""
    named = lambda prompt: prompt.split(", column ", 1)[1].split(":", 1)[0]
    _, store = _run(spark, sf_dir, explain=lambda: lambda ps: [f"explained {named(p)}" for p in ps])
    return store.table("anomalies").groupBy("llm_explanation").agg(F.count(F.lit(1)).alias("cells"))


@query("etl_metrics", f"""{_READY}, spans as (select *, date_trunc('month', start_date) as s,
    date_trunc('month', churn_date) as c from ready),
  months as (select distinct s as m from spans),
  sums as (select strftime(m, '%Y-%m') as period,
    sum(case when s <= m and (c is null or c > m) then cast(mrr as decimal(38,10)) else 0 end) as active_v,
    sum(case when s = m then cast(mrr as decimal(38,10)) else 0 end) as new_v,
    sum(case when c = m then cast(mrr as decimal(38,10)) else 0 end) as churn_v,
    count(case when s <= m and (c is null or c > m) then 1 end) as active_customers,
    count(case when s = m then 1 end) as new_customers,
    count(case when c = m then 1 end) as churned_customers
  from months join spans on s <= m or c = m group by m)
  select period, active_customers, new_customers, churned_customers, round(cast(active_v as double), 2) as mrr,
    round(cast(new_v as double), 2) as new_mrr, round(cast(churn_v as double), 2) as churned_mrr,
    round(cast(new_v as double) - cast(churn_v as double), 2) as net_new_mrr,
    round(cast(churned_customers as double) / greatest(active_customers, 1), 4) as churn_rate,
    round(cast(active_v as double) / greatest(active_customers, 1), 2) as arpu,
    round(cast(active_v as double) / greatest(cast(active_v - new_v + churn_v as double), 1) * 100, 2) as nrr
  from sums""")
def stored_metrics(spark, sf_dir):
    _, store = _run(spark, sf_dir)
    return as_doubles(store.table("metrics").select(
        "period", "mrr", "new_mrr", "churned_mrr", "net_new_mrr", "churn_rate", "arpu", "nrr",
        *[F.col(c).cast("bigint").alias(c) for c in ("active_customers", "new_customers", "churned_customers")]))


@query("etl_state", f"""{_READY} select 'orders' as id, 'ready' as status,
  (select count(*) from subs) as row_count, 13 as column_count, 'completed' as job_status,
  100 as progress, 'done' as stage, (select count(*) from ready) as rows_cleaned""")
def final_state(spark, sf_dir):
    """Registry and job log after the run."""
    _, store = _run(spark, sf_dir)
    jobs = store.jobs().select(
        F.col("dataset_id").alias("id"), F.col("status").alias("job_status"), "progress", "stage",
        F.col("rows_cleaned").cast("bigint").alias("rows_cleaned"))
    return store.datasets().select(
        "id", "status", F.col("row_count").cast("bigint").alias("row_count"), "column_count",
    ).join(jobs, "id")


_QUESTION = """SELECT plan, AVG(churned::int) as churn_rate FROM saas_subscriptions
  WHERE dataset_id = 'orders' GROUP BY plan ORDER BY churn_rate DESC, plan LIMIT 1"""


@query("answer", f"""with saas_subscriptions as (select *, 'orders' as dataset_id
  from ({SUBSCRIPTIONS})) {_QUESTION}""")
def answered(spark, sf_dir):
    """A statement over the stored tables, as the service runs and logs it."""
    store = Store(spark, new_path(spark, "store"))
    store.write_subscriptions(
        subscriptions(spark, sf_dir).withColumn("dataset_id", F.lit("orders")))
    return spark.createDataFrame(answer(store, "Which plan has the highest churn rate?", _QUESTION))


_ROWS = f"""select 'subscriptions' as table_name, count(*) as rows, sum(mrr) as amount from ready
  union all select 'metrics', count(distinct date_trunc('month', start_date)), null from ready
  union all select 'anomalies', count(*), null from ({_CELLS})"""


@query("broken_run", f"{_READY} select table_name, rows, round(amount, 0) as amount from ({_ROWS})")
def broken_run(spark, sf_dir):
    """A second run on other rows that breaks off at its last step: all tables are still those of the first."""
    _, store = _run(spark, sf_dir)

    def broken():
        raise RuntimeError("the model is gone")

    path = new_path(spark, "export")
    subscriptions(spark, sf_dir).filter("subscription_id % 3 = 0").write.option("header", True).csv(path)
    try:
        run_etl(spark, store, "orders", "csv", path=path, key=("subscription_id",), explain=broken)
    except Exception:
        pass
    counted = lambda name, amount: store.table(name).agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), amount.alias("amount"))
    none = F.lit(None).cast("double")
    return counted("subscriptions", F.round(F.sum(F.col("mrr").cast("double")), 0)).unionByName(
        counted("metrics", none)).unionByName(counted("anomalies", none))


# Every seventh line has a field too many, every tenth date of the others is none.
_NUMBERED = f"""numbered as (select *, row_number() over (order by subscription_id) - 1 as row_index from ({SUBSCRIPTIONS}))"""


def _flawed_export(spark, sf_dir):
    path = new_path(spark, "flawed")
    day = F.date_format("start_date", "yyyy-MM-dd")
    line = F.concat_ws(
        ",", F.col("subscription_id").cast("string"), "customer_id", F.lit("p"), F.lit("10"), F.lit("active"),
        F.when(F.col("subscription_id") % 10 == 0, F.concat(F.lit("about "), day)).otherwise(day),
        F.when(F.col("subscription_id") % 7 == 0, F.lit("extra")))
    ordered = _in_files(subscriptions(spark, sf_dir, lines=False), 3, "subscription_id")
    ordered.select(line.alias("subscription_id,customer_id,plan,mrr,status,start_date")).write.options(
        header=True, quote="", sep="\x01").csv(path)
    return path


@query("run_rejects", f"""with {_NUMBERED}, flawed as (select *, subscription_id % 7 = 0 as long,
    concat(case when subscription_id % 10 = 0 then 'about ' else '' end, strftime(start_date, '%Y-%m-%d')) as day from numbered)
  select row_index, concat_ws(',', subscription_id, customer_id, 'p', 10, 'active', day, 'extra') as line,
    null::varchar as column_name, null::varchar as value, 'more than 6 fields' as reason from flawed where long
  union all select row_index, null, 'start_date', day, 'no date in the column''s form' from flawed
  where not long and subscription_id % 10 = 0""")
def run_rejects(spark, sf_dir):
    """What a run skipped or lost, stored with the record's number in the source."""
    store = Store(spark, new_path(spark, "store"))
    run_etl(spark, store, "orders", "csv", path=_flawed_export(spark, sf_dir), key=("subscription_id",), detect=False)
    return store.table("rejects").select("row_index", "line", "column_name", "value", "reason")


@query("run_report", f"""select count(*) as records, count(*) filter (subscription_id % 7 = 0) as lines_skipped,
  count(*) filter (subscription_id % 7 <> 0) as final_rows,
  count(*) filter (subscription_id % 7 <> 0 and subscription_id % 10 = 0) as dates_lost from ({SUBSCRIPTIONS})""")
def run_report(spark, sf_dir):
    """The cleaning part of the registry's report."""
    store = Store(spark, new_path(spark, "store"))
    run_etl(spark, store, "orders", "csv", path=_flawed_export(spark, sf_dir), key=("subscription_id",), detect=False)
    cleaning = F.from_json(
        F.get_json_object("validation_report", "$.cleaning"),
        "original_rows bigint, final_rows bigint, lines_skipped bigint, dates_lost map<string, bigint>")
    return store.datasets().select(cleaning.alias("c")).select(
        (F.col("c.original_rows") + F.col("c.lines_skipped")).alias("records"), "c.lines_skipped", "c.final_rows",
        F.col("c.dates_lost")["start_date"].alias("dates_lost"))


@query("record_numbers", """select row_number() over (order by l_orderkey, l_linenumber) - 1 as row_index,
  l_orderkey as order_ref, l_linenumber as line_ref from lineitem""")
def record_numbers(spark, sf_dir):
    """The numbers of the records of a source in several files, which are read in several splits."""
    path = new_path(spark, "numbered")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_ref"), F.col("l_linenumber").alias("line_ref"))
    _in_files(lines, 5, "order_ref", "line_ref").write.option("header", True).csv(path)
    return land_source(spark, "csv", path=path).frame.select(
        F.col(ROW_INDEX).alias("row_index"), "order_ref", F.col("line_ref").cast("int").alias("line_ref"))


@query("anomaly_row_index", f"""{_READY}, placed as (select subscription_id as row_key,
    row_number() over (order by subscription_id) - 1 as row_index from ready)
  select row_index, column_name, value from ({_CELLS}) join placed using (row_key)""")
def anomaly_row_index(spark, sf_dir):
    """Stored anomalies with the number of their record, each copy of which counts as the first one."""
    path = new_path(spark, "export")
    subs = subscriptions(spark, sf_dir).withColumn("copy", F.lit(0))
    both = subs.unionByName(subs.filter("subscription_id % 5 = 0").withColumn("copy", F.lit(1)))
    _in_files(both, 5, "copy", "subscription_id").drop("copy").write.option("header", True).csv(path)
    store = Store(spark, new_path(spark, "store"))
    run_etl(spark, store, "orders", "csv", path=path, key=("subscription_id",))
    return store.table("anomalies").select("row_index", "column_name", "value")


_KEPT_UP = ("period", "mrr", "new_mrr", "churned_mrr", "net_new_mrr", "active_customers", "new_customers", "churned_customers",
            "churn_rate", "arpu", "nrr")


@query("metrics_kept_up", f"""with {metrics_ctes(where="country <> 'FRANCE' and subscription_id % 2 = 0")}
  select {', '.join(_KEPT_UP)}, (select count(*) from spans) as stored from metrics""")
def metrics_kept_up(spark, sf_dir):
    """Rows that come in three parts, and rows that leave: the metrics of what is stored then."""
    store, key = Store(spark, new_path(spark, "store")), F.col("subscription_id")
    subs = subscriptions(spark, sf_dir).withColumns({"dataset_id": F.lit("orders"), "mrr": F.col("mrr").cast("double")})
    first = subs.filter(key % 6 == 0)
    store.write_subscriptions(first, one_dataset=True, run_id="first")
    write_months(store, "orders", first, "first")
    store.publish("orders", dict.fromkeys(("subscriptions", "metrics", "month_pairs"), "first"))
    for part in (2, 4):
        append_subscriptions(store, "orders", subs.filter(key % 6 == part))
    append_subscriptions(store, "orders", subs.filter((key % 2 == 1) & (F.col("country") == "FRANCE")).withColumn(
        "customer_id", F.concat(F.lit("odd "), "customer_id")))
    french = store.table("subscriptions").filter("country = 'FRANCE'").select("customer_id").distinct()
    remove_subscriptions(store, "orders", french)
    stored = store.table("subscriptions").agg(F.count(F.lit(1)).alias("stored"))
    counts = [F.col(c).cast("bigint").alias(c) for c in _KEPT_UP if c.endswith("customers")]
    return as_doubles(store.table("metrics").select(*[c for c in _KEPT_UP if not c.endswith("customers")], *counts)).join(stored)
