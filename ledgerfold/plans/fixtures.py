"""Subscription tables derived from the order tables the queries run on.

One order stands for one subscription. Each SQL text is the oracle's common
table expression; where Spark runs the same text, it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = ("mrr", "arr", "new_mrr", "churned_mrr", "net_new_mrr", "total_mrr", "total_arr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_doubles(df: DataFrame, columns: tuple[str, ...] = MONEY) -> DataFrame:
    """Amounts as doubles, the form results are compared in."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns if c in df.columns})


# --- Subscriptions -----------------------------------------------------------

SUBSCRIPTIONS = """
select o.o_orderkey as subscription_id,
  concat('cust_', cast(o.o_custkey as varchar(20))) as customer_id,
  c.c_name as customer_name, o.o_orderpriority as plan,
  cast(o.o_totalprice as decimal(12,2)) as mrr,
  case o.o_orderstatus when 'F' then 'churned' when 'O' then 'active' else 'trial' end as status,
  o.o_orderstatus = 'F' as churned,
  case when o.o_orderstatus <> 'F' then cast(null as varchar(40))
       when o.o_orderkey % 6 = 0 then 'Too expensive for our budget'
       when o.o_orderkey % 6 = 1 then 'Switched to competitor'
       when o.o_orderkey % 6 = 2 then 'Missing key features'
       when o.o_orderkey % 6 = 3 then 'Poor customer support experience'
       when o.o_orderkey % 6 = 4 then 'Not using the product enough'
       else 'Company went out of business' end as churn_reason,
  o.o_orderdate as start_date,
  case when o.o_orderstatus = 'F' then l.last_ship end as churn_date,
  n.n_name as country, c.c_mktsegment as industry, cast(l.seats as int) as seats
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
left join (select l_orderkey, max(l_shipdate) as last_ship, sum(l_quantity) as seats
           from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey
"""

_REASONS = (
    "Too expensive for our budget", "Switched to competitor", "Missing key features",
    "Poor customer support experience", "Not using the product enough",
)


def subscriptions(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """The shared fixture.

    `lines=False` leaves out churn date and seats, and with them the line item
    scan: that join is a left join on a unique key and cannot change the rows.
    """
    orders, customer, nation = (
        table(spark, sf_dir, t).alias(t) for t in ("orders", "customer", "nation"))
    status = F.col("o_orderstatus")
    reason = F.when(status != "F", F.lit(None))
    for i, text in enumerate(_REASONS):
        reason = reason.when(F.col("o_orderkey") % 6 == i, F.lit(text))
    subs = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    late = []
    if lines:
        per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("quantity"))
        subs = subs.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        late = [F.when(status == "F", F.col("last_ship")).alias("churn_date"),
                F.col("quantity").cast("int").alias("seats")]
    return subs.select(
        F.col("o_orderkey").alias("subscription_id"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("customer_name"), F.col("o_orderpriority").alias("plan"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("mrr"),
        F.when(status == "F", "churned").when(status == "O", "active").otherwise("trial")
        .alias("status"),
        (status == "F").alias("churned"),
        reason.otherwise(F.lit("Company went out of business")).alias("churn_reason"),
        F.col("o_orderdate").alias("start_date"),
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("industry"), *late,
    )


# Monthly snapshots by the interval join, per dataset (here: country) or not.

def metrics_ctes(by: bool = False, where: str = "true") -> str:
    key = "dataset_id, " if by else ""
    match = "p.dataset_id = x.dataset_id and " if by else ""
    return f"""
  subs as ({SUBSCRIPTIONS}),
  spans as (select *, country as dataset_id, date_trunc('month', start_date) as s,
            date_trunc('month', churn_date) as c from subs where {where}),
  months as (select distinct {key} s as m from spans where s is not null),
  sums as (
    select {'p.dataset_id, ' if by else ''} p.m,
      sum(case when s <= m and (c is null or c > m) then mrr else 0 end) as active_v,
      sum(case when s = m then mrr else 0 end) as new_v,
      sum(case when c = m then mrr else 0 end) as churn_v,
      count(case when s <= m and (c is null or c > m) then 1 end) as active_n,
      count(case when s = m then 1 end) as new_n,
      count(case when c = m then 1 end) as churn_n
    from months p join spans x on {match} (s <= m or c = m)
    group by {'p.dataset_id, ' if by else ''} p.m),
  metrics as (
    select {key} strftime(m, '%Y-%m') as period,
      cast(active_v as double) as mrr, cast(new_v as double) as new_mrr,
      cast(0 as double) as expansion_mrr, cast(churn_v as double) as churned_mrr,
      cast(new_v - churn_v as double) as net_new_mrr,
      active_n as active_customers, new_n as new_customers, churn_n as churned_customers,
      cast(printf('%.4f', cast(churn_n as double) / cast(greatest(active_n, 1) as double)) as double)
        as churn_rate,
      cast(printf('%.2f', cast(active_v as double) / cast(greatest(active_n, 1) as double)) as double)
        as arpu,
      cast(printf('%.2f', cast(active_v as double)
        / greatest(cast(active_v - new_v + churn_v as double), 1) * 100) as double) as nrr
    from sums)"""


# --- Derived subscriptions with labels ----------------------------------------

DAYS = "floor((epoch_us(churn_date) - epoch_us(start_date)) / 86400000000.0)"
LIFETIME = f"round_even({DAYS} / cast(30.44 as double) * 10, 0) / 10"

# --- Dirty input --------------------------------------------------------------
# Spark runs the same text.

MESSY = """
select concat('row_', cast(l_orderkey as string), '_', cast(l_linenumber as string)) as line_ref,
  concat('cust_', cast(l_suppkey as string)) as customer_id,
  case when l_orderkey % 20 = 0 then null
       when l_orderkey % 97 = 0 then 'n/a'
       when l_orderkey % 101 = 0 then cast(cast(l_extendedprice as decimal(12,2)) * 50 as string)
       else cast(cast(l_extendedprice as decimal(12,2)) as string) end as mrr,
  case when l_partkey % 11 = 0 then null else l_quantity end as seats,
  case l_linenumber % 5 when 0 then 'true' when 1 then 'yes' when 2 then 'no'
       when 3 then 'True' end as churned,
  case when l_orderkey % 31 = 0 then 'not a date' when l_orderkey % 13 = 0 then null
       else cast(cast(l_shipdate as date) as string) end as start_date,
  case when l_orderkey % 10 < 7 then null
       else cast(cast(l_shipdate as date) as string) end as churn_date,
  case when l_partkey % 12 = 0 then 'high' else cast(l_linenumber * 3 as string) end as usage_score,
  case when l_partkey % 2 = 0 then 'A' else cast(l_partkey as string) end as part_code,
  case when l_orderkey % 9 = 0 then null else l_returnflag end as country,
  case when l_orderkey % 5 = 0 then 'call back' end as note
from {lines}
"""
MESSY_SQL = (MESSY.format(lines="lineitem") + " union all "
             + MESSY.format(lines="lineitem where l_orderkey % 10 = 0"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (MESSY.format(lines="{lineitem}") + " union all "
            + MESSY.format(lines="{lineitem} where l_orderkey % 10 = 0"))
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


# --- Registry and logs, from the event stream ----------------------------------
# Spark runs the same texts.

DATASET_LOG = """
select concat('ds_', cast(user_id as string)) as id, concat('set_', cast(user_id as string)) as name,
  'saas' as domain,
  case user_id % 3 when 0 then 'csv' when 1 then 'sql' else 'api' end as source_type,
  cast(floor(value) as int) as row_count, cast(event_id % 12 as int) as column_count,
  case event_type when 'signup' then 'pending' when 'view' then 'processing'
       when 'error' then 'failed' else 'ready' end as status,
  timestamp '2024-01-01 00:00:00' as created_at, ts as updated_at
from {events}
"""
JOB_LOG = """
select concat('job_', cast(user_id as string)) as id, concat('ds_', cast(user_id as string)) as dataset_id,
  case event_type when 'error' then 'failed' when 'purchase' then 'completed'
       else 'processing' end as status,
  cast(event_id % 101 as int) as progress,
  case event_type when 'signup' then 'fetching' when 'view' then 'cleaning'
       when 'click' then 'storing' when 'error' then props else 'done' end as stage,
  cast(floor(value * 100) as int) as rows_processed, cast(floor(value * 10) as int) as rows_enriched,
  ts as updated_at
from {events}
"""
QUERY_LOG = """
select cast(event_id as string) as id, concat(event_type, ' ', props) as question,
  concat('select ', cast(user_id as string)) as generated_sql, cast(user_id as int) as result_rows,
  value * 10 as latency_ms, event_type <> 'error' as success, ts as created_at
from {events}
"""
REPORT_LOG = """
select cast(doc_id as string) as id, source as dataset_id, '2024-01' as period, lang as report_type,
  text as markdown_content,
  case when doc_id % 3 = 0 then concat('reports/', cast(doc_id as string), '.pdf') end as pdf_path,
  cast(n_chars as int) as tokens_used
from {documents}
"""


def from_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORT_LOG, documents=table(spark, sf_dir, "documents"))


def newest_sql(log: str) -> str:
    """Newest row per id of an event log, as an oracle query."""
    body = log.format(events="events")
    return (f"select * exclude (rn) from (select *, row_number() over "
            f"(partition by id order by updated_at desc) as rn from ({body})) where rn = 1")


# --- Anomalies ----------------------------------------------------------------

def anomalies_sql(source: str, key: str, columns: tuple[str, ...], extra: str = "") -> str:
    """Oracle of the anomalous cells of some columns."""
    parts = []
    for c in columns:
        parts.append(f"""
  select {key} as row_key{extra}, '{c}' as column_name, x as value, z as score,
    case when z > 2.5 and (x < lo or x > hi) then 'zscore+iqr' when z > 2.5 then 'zscore'
         else 'iqr' end as method,
    case when z > 4 then 'high' when z > 3 then 'medium' else 'low' end as severity,
    printf('%.2f – %.2f', lo, hi) as expected_range
  from (
    select *, cast({c} as double) as x, abs((cast({c} as double) - m) / sd) as z
    from {source} cross join (
      select avg(cast({c} as double)) as m, stddev_samp(cast({c} as double)) as sd,
        quantile_cont(cast({c} as double), 0.25) - 1.5 * (quantile_cont(cast({c} as double), 0.75)
          - quantile_cont(cast({c} as double), 0.25)) as lo,
        quantile_cont(cast({c} as double), 0.75) + 1.5 * (quantile_cont(cast({c} as double), 0.75)
          - quantile_cont(cast({c} as double), 0.25)) as hi
      from {source})
  ) where z > 2.5 or x < lo or x > hi""")
    return " union all ".join(parts)
