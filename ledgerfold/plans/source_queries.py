"""Readers, sinks, registry and logs over tables Spark writes from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paging import nth_page
from ..functions.scratch import new_path, stage
from ..operators.snapshot import monthly_snapshot
from ..operators.clean import cast_dates, clean
from ..operators.outliers import anomalies, row_key
from ..sources import (
    Store, content_fingerprint, normalize_headers, read_csv, read_json_records, read_source,
    read_sql, read_tsv, source_metadata,
)
from ..sources.readers import file_fingerprints, read_json_mixed
from ..sources.store import (
    DATASET_ORDER, HISTORY_ORDER, active_dataset_count, dataset_list, newest, query_history, taken_names, without_datasets,
)
from .fixtures import (
    DATASET_LOG, JOB_LOG, QUERY_LOG, REPORT_LOG, SUBSCRIPTIONS, anomalies_sql, as_doubles,
    from_events, metrics_ctes, newest_sql, report_log, subscriptions, table,
)
from .registry import query

CUSTOMER_SQL = """select c_custkey as customer_id, c_name as customer_name, c_acctbal as mrr,
  case when c_custkey % 7 <> 0 then c_mktsegment end as industry, c_custkey % 2 = 0 as churned
  from customer"""


def _customer_text(spark, sf_dir):
    """Customers under untidy headers; the quoted name holds the delimiter."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer-ID"),
        F.concat(F.lit("a,"), "c_name").alias(" Customer Name "),
        F.col("c_acctbal").alias("MRR"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("Industry"),
        F.initcap((F.col("c_custkey") % 2 == 0).cast("string")).alias("churned"),
    )


_CSV_ORACLE = f"""select customer_id, concat('a,', customer_name) as customer_name, mrr, industry,
  churned from ({CUSTOMER_SQL})"""


@query("read_csv", _CSV_ORACLE)
def csv(spark, sf_dir):
    path = new_path(spark, "csv")
    rows = _customer_text(spark, sf_dir)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path)


@query("exact_whole_numbers", """select count(distinct l_orderkey) as codes,
  count(distinct l_orderkey) as long_codes, 1234567890000000000 + max(l_orderkey) as largest,
  count(*) as rows from (select distinct l_orderkey from lineitem)""")
def exact_whole_numbers(spark, sf_dir):
    """19- and 25-digit codes through the reader and the cleaner: no two become one."""
    path = new_path(spark, "codes")
    key = F.col("l_orderkey") + 1234567890000000000
    table(spark, sf_dir, "lineitem").select(
        key.cast("string").alias("code_ref"), F.concat(key.cast("string"), F.lit("000001")).alias("long_ref"),
        F.when(F.col("l_orderkey") % 50 != 0, key.cast("string")).alias("gappy_ref"),
    ).write.option("header", True).csv(path)
    cleaned = clean(read_csv(spark, path)).frame
    return cleaned.agg(
        F.count_distinct("code_ref").alias("codes"), F.count_distinct("long_ref").alias("long_codes"),
        F.max("code_ref").cast("bigint").alias("largest"), F.count(F.lit(1)).alias("rows"))


@query("cast_dates_forms", """select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as start_date,
  strftime(l_shipdate + interval 40 day, '%Y-%m-%d') as end_date from lineitem""")
def cast_dates_forms(spark, sf_dir):
    """Dates written month first in one column and day first in another."""
    texts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "MM/dd/yyyy").alias("start_date"),
        F.date_format(F.date_add("l_shipdate", 40), "dd.MM.yyyy").alias("end_date"))
    return cast_dates(texts).select(
        "l_orderkey", "l_linenumber", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("end_date", "yyyy-MM-dd").alias("end_date"))


@query("file_fingerprints", """select c_mktsegment as segment, substring(sha256(
  string_agg(concat(c_custkey, ',', c_name, chr(10)), '' order by c_custkey)), 1, 16) as fingerprint
  from customer group by c_mktsegment""")
def fingerprints_of_parts(spark, sf_dir):
    """One file per segment, each with its rows in order; the fingerprint of each file."""
    path = new_path(spark, "parts")
    rows = table(spark, sf_dir, "customer").select(
        F.concat_ws(",", "c_custkey", "c_name").alias("value"), "c_custkey", "c_mktsegment")
    (rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey")
     .select("value", "c_mktsegment").write.partitionBy("c_mktsegment").text(path))
    return file_fingerprints(spark, path).select(
        F.url_decode(F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1)).alias("segment"), "fingerprint")


@query("read_csv_ragged", """select c_custkey as customer_id, c_name as customer_name,
  case when c_custkey % 4 <> 0 then c_mktsegment end as industry
  from customer where c_custkey % 5 <> 0""")
def csv_ragged(spark, sf_dir):
    """Every fourth row lacks its last field, every fifth has one too many."""
    path = new_path(spark, "ragged")
    key = F.col("c_custkey")
    line = F.concat_ws(
        ";", key.cast("string"), "c_name",
        F.when((key % 4 != 0) | (key % 5 == 0), F.col("c_mktsegment")),
        F.when(key % 5 == 0, F.lit("extra")))
    rows = table(spark, sf_dir, "customer").select(
        line.alias("customer_id;customer_name;industry"))
    rows.write.options(header=True, quote="", sep="\x01").csv(path)
    return read_csv(spark, path)


@query("read_tsv", _CSV_ORACLE)
def tsv(spark, sf_dir):
    path = new_path(spark, "tsv")
    _customer_text(spark, sf_dir).write.options(header=True, sep="\t", escape='"').csv(path)
    return read_tsv(spark, path)


@query("read_sql", """select o_orderpriority as plan, count(*) as orders
  from orders where o_orderstatus = 'F' group by o_orderpriority""")
def sql(spark, sf_dir):
    """A given SELECT on the catalog; a JDBC source takes the same path with a url."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("source_orders")
    return read_sql(spark, "select o_orderpriority as `Plan`, count(*) as `Orders` "
                           "from source_orders where o_orderstatus = 'F' group by 1")


@query("read_json_records", """select event_id, user_id as user_ref_id, event_type as kind_type,
  value as kind_value from events""")
def json_records(spark, sf_dir):
    """One payload per event, its nested record in a list below a dotted key."""
    path = new_path(spark, "json")
    records = F.struct(
        "event_id", F.struct(F.struct(F.col("user_id").alias("ID")).alias("ref")).alias("user"),
        F.struct(F.col("event_type").alias("type"), F.col("value").alias("value")).alias("kind"))
    payload = table(spark, sf_dir, "events").select(
        F.struct(F.array(records).alias("items")).alias("data"), F.lit("ok").alias("status"))
    payload.write.json(path)
    schema = ("data struct<items: array<struct<event_id: bigint, user: struct<ref: struct<ID: bigint>>, "
              "kind: struct<type: string, value: double>>>>")
    return read_json_records(spark, path, data_key="data.items", schema=schema)


@query("read_json_mixed", """select event_id, user_id as user_ref_id, case when event_id % 10 = 0
  then cast(user_id as varchar) else event_type end as kind, case when event_id % 3 = 0 then value end as value,
  null::varchar as reason from events where event_id % 50 not in (7, 11)
  union all select null, null, null, null, case when event_id % 50 = 7 then 'a record that is no object' else 'no JSON' end
  from events where event_id % 50 in (7, 11)""")
def json_mixed(spark, sf_dir):
    """Payloads with a list, with one object, with a number and of broken text; a field that is text or number."""
    path, key = new_path(spark, "mixed"), F.col("event_id")
    record = lambda kind, **more: F.struct(
        "event_id", F.struct(F.struct(F.col("user_id").alias("ID")).alias("ref")).alias("user"), kind.alias("kind"),
        *[v.alias(n) for n, v in more.items()])
    items = lambda value: F.to_json(F.struct(F.struct(value.alias("items")).alias("data")))
    line = (
        F.when(key % 50 == 7, items(key)).when(key % 50 == 11, F.lit('{"data": {"items": [{'))
        .when(key % 10 == 0, items(F.array(record(F.col("user_id"), value=F.when(key % 3 == 0, F.col("value"))))))
        .when(key % 3 == 0, items(record(F.col("event_type"), value=F.col("value"))))
        .otherwise(items(F.array(record(F.col("event_type"))))))
    table(spark, sf_dir, "events").select(line).write.text(path)
    rows, rejects = read_json_mixed(spark, path, "data.items")
    return rows.withColumn("value", F.col("value").cast("double")).unionByName(
        rejects.select("reason"), allowMissingColumns=True)


@query("normalize_headers", """select s_suppkey as supplier_key, s_name as name,
  s_acctbal as account_balance from supplier""")
def headers(spark, sf_dir):
    return normalize_headers(table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(" Supplier Key"), F.col("s_name").alias("NAME"),
        F.col("s_acctbal").alias("Account-Balance")))


@query("read_source", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def source(spark, sf_dir):
    frame = read_source(spark, "Parquet", path=f"{sf_dir}/orders.parquet")
    return frame.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("source_metadata", """select 'lineitem' as source_name, 'parquet' as source_type,
  count(*) as rows, 'l_orderkey,l_quantity' as columns from lineitem""")
def metadata(spark, sf_dir):
    return source_metadata(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"),
                           "lineitem", "parquet")


# --- Dataset tables -----------------------------------------------------------

def _by_country(spark, sf_dir):
    return subscriptions(spark, sf_dir).withColumn("dataset_id", F.col("country"))


@query("write_subscriptions", f"""select country as dataset_id, customer_id, plan,
  case when country = 'FRANCE' then 'replaced' else status end as status,
  cast(mrr as double) as mrr, churned, strftime(start_date, '%Y-%m-%d') as start_date, seats
  from ({SUBSCRIPTIONS})""")
def write_subs(spark, sf_dir):
    """All datasets are stored; then one of them is replaced."""
    store = Store(spark, new_path(spark, "store"))
    subs = _by_country(spark, sf_dir)
    store.write_subscriptions(subs)
    store.write_subscriptions(
        subs.filter("country = 'FRANCE'").withColumn("status", F.lit("replaced")))
    stored = store.table("subscriptions").withColumn(
        "start_date", F.date_format("start_date", "yyyy-MM-dd"))
    return as_doubles(stored.select(
        "dataset_id", "customer_id", "plan", "status", "mrr", "churned", "start_date", "seats"))


@query("write_metrics", f"""with {metrics_ctes(by=True)}
  select dataset_id, period, mrr, new_mrr, churned_mrr, net_new_mrr, active_customers,
  churn_rate, nrr, arpu from metrics""")
def write_metrics(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    store.write_metrics(monthly_snapshot(_by_country(spark, sf_dir), by=("dataset_id",)))
    return as_doubles(store.table("metrics").select(
        "dataset_id", "period", "mrr", "new_mrr", "churned_mrr", "net_new_mrr",
        F.col("active_customers").cast("bigint").alias("active_customers"),
        "churn_rate", "nrr", "arpu"))


_STORED_CONTEXT = """, concat('{"event_id":', event_id, ',"event_type":"', event_type, '"}') as row_context,
  event_id, user_id"""


@query("write_anomalies", f"""select 'events' as dataset_id, column_name, method, value,
  round(score, 4) as score, severity, row_context, event_id, user_id
  from ({anomalies_sql('events', 'event_id', ('value',), _STORED_CONTEXT)})""")
def write_anomalies(spark, sf_dir):
    """Stored anomalies, each joined back to its row by the stored key."""
    store = Store(spark, new_path(spark, "store"))
    events = table(spark, sf_dir, "events")
    found = anomalies(events, keep=("event_id",), columns=["value"], context=["event_id", "event_type"])
    store.write_anomalies(found.withColumns({"dataset_id": F.lit("events"), "row_key": row_key(("event_id",))}))
    stored = store.table("anomalies").select(
        "dataset_id", "column_name", "method", "value", F.round("score", 4).alias("score"),
        "severity", "row_context", F.from_json("row_key", "event_id bigint")["event_id"].alias("event_id"))
    return stored.join(events.select("event_id", "user_id"), "event_id")


@query("delete_dataset", f"""select country as dataset_id, count(*) as rows, 1 as registered, 1 as jobs,
  1 as reports from ({SUBSCRIPTIONS}) where country <> 'FRANCE' group by country""")
def delete_dataset(spark, sf_dir):
    """A deleted dataset leaves its table, the registry, the jobs and the reports."""
    store = Store(spark, new_path(spark, "store"))
    subs = _by_country(spark, sf_dir)
    store.write_subscriptions(subs)
    ids = subs.select("dataset_id").distinct()
    store.append("datasets", ids.select(
        F.col("dataset_id").alias("id"), F.col("dataset_id").alias("name"), F.lit("ready").alias("status")))
    for log in ("jobs", "reports"):
        store.append(log, ids)
    store.delete_dataset("FRANCE")
    counted = lambda df, key, name: df.groupBy(F.col(key).alias("dataset_id")).agg(
        F.count(F.lit(1)).alias(name))
    return (
        counted(store.table("subscriptions"), "dataset_id", "rows")
        .join(counted(store.datasets(), "id", "registered"), "dataset_id", "full")
        .join(counted(store.jobs(), "dataset_id", "jobs"), "dataset_id", "full")
        .join(counted(store.reports(), "dataset_id", "reports"), "dataset_id", "full"))


@query("write_empty_dataset", f"""select country as dataset_id, count(*) as rows
  from ({SUBSCRIPTIONS}) where country <> 'FRANCE' group by country""")
def write_empty_dataset(spark, sf_dir):
    """A run without rows replaces the rows of the one before."""
    store = Store(spark, new_path(spark, "store"))
    subs = _by_country(spark, sf_dir)
    store.write_subscriptions(subs)
    store.write_subscriptions(subs.filter("false"), one_dataset=True, datasets=("FRANCE",))
    return store.table("subscriptions").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))


@query("registry_keeps_config", f"""select id, case when id % 2 = 0 then concat('hash-', id) end as etl_config,
  'ready' as status, '2024-01-01' as created from (select distinct c_custkey as id from customer)""")
def registry_keeps_config(spark, sf_dir):
    """What the first event of a dataset says holds until a later one says otherwise."""
    store = Store(spark, new_path(spark, "store"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    event = lambda status, day: ids.select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("set_"), "id").alias("name"), F.lit(status).alias("status"),
        F.to_timestamp_ntz(F.lit(day)).alias("created_at"), F.to_timestamp_ntz(F.lit(day)).alias("updated_at"),
        F.when((F.col("id") % 2 == 0) & F.lit(status == "pending"), F.concat(F.lit("hash-"), "id")).alias("etl_config"))
    store.append("datasets", event("pending", "2024-01-01 00:00:00"))
    store.append("datasets", event("ready", "2024-01-02 00:00:00"))
    return store.datasets().select(
        F.col("id").cast("bigint").alias("id"), "etl_config", "status",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("rows_after_delete", """select o_orderkey, o_custkey from orders where o_custkey not in
  (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def rows_after_delete(spark, sf_dir):
    """Anti-join form, for many deleted ids at once."""
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("dataset_id"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_custkey").alias("dataset_id"))
    return without_datasets(orders, gone).select("o_orderkey", "o_custkey")


# --- Registry and logs ----------------------------------------------------------

@query("dataset_registry", f"""select id, name, source_type, status, row_count, column_count
  from ({newest_sql(DATASET_LOG)})""")
def registry(spark, sf_dir):
    """Appended states, stored and reduced to the newest per dataset."""
    store = Store(spark, new_path(spark, "store"))
    store.append("datasets", from_events(spark, sf_dir, DATASET_LOG))
    return store.datasets().select(
        "id", "name", "source_type", "status", "row_count", "column_count")


@query("dataset_list", f"""select id, name, status, (select count(*) from ({newest_sql(DATASET_LOG)}))
  as total from ({newest_sql(DATASET_LOG)}) order by created_at, id limit 50 offset 20""")
def listing(spark, sf_dir):
    datasets = newest(from_events(spark, sf_dir, DATASET_LOG))
    total = datasets.count()
    return dataset_list(datasets, skip=20, limit=50).select(
        "id", "name", "status", F.lit(total).cast("bigint").alias("total"))


@query("dataset_pages", f"""select id, name, status from ({newest_sql(DATASET_LOG)}) order by created_at, id limit 30 offset 30""")
def dataset_pages(spark, sf_dir):
    """The second page of thirty, behind the thirtieth dataset; all were created at the same time."""
    datasets = stage(newest(from_events(spark, sf_dir, DATASET_LOG)), "registry")
    read = lambda cursor: dataset_list(datasets, limit=30, cursor=cursor)
    return nth_page(read, DATASET_ORDER, 30, 1).select("id", "name", "status")


@query("history_pages", f"""select id, question, latency_ms from ({QUERY_LOG.format(events='events')})
  order by created_at desc, id desc limit 25 offset 50""")
def history_pages(spark, sf_dir):
    """The third page of the query log, behind the second one's last row."""
    log = stage(from_events(spark, sf_dir, QUERY_LOG), "log")
    return nth_page(lambda cursor: query_history(log, 25, cursor), HISTORY_ORDER, 25, 2).select("id", "question", "latency_ms")


@query("dataset_name_guard", f"""select distinct concat('set_', c_custkey) as name from customer
  where concat('set_', c_custkey) in
  (select name from ({newest_sql(DATASET_LOG)}) where status = 'ready')""")
def name_guard(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("set_"), F.col("c_custkey").cast("string")).alias("name"))
    return taken_names(wanted, newest(from_events(spark, sf_dir, DATASET_LOG)))


@query("content_fingerprint",
       "select doc_id, substring(sha256(text), 1, 16) as fingerprint from documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", content_fingerprint(F.col("text")).alias("fingerprint"))


@query("job_log", f"""select id, dataset_id, status, progress, stage, rows_processed
  from ({newest_sql(JOB_LOG)})""")
def job_log(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    store.append("jobs", from_events(spark, sf_dir, JOB_LOG))
    return store.jobs().select("id", "dataset_id", "status", "progress", "stage", "rows_processed")


@query("query_history", f"""select id, question, generated_sql, result_rows, latency_ms, success
  from ({QUERY_LOG.format(events='events')}) order by created_at desc, id desc limit 20""")
def history(spark, sf_dir):
    return query_history(from_events(spark, sf_dir, QUERY_LOG)).select(
        "id", "question", "generated_sql", "result_rows", "latency_ms", "success")


@query("report_log", f"""select id, dataset_id, report_type, markdown_content, pdf_path, tokens_used
  from ({REPORT_LOG.format(documents='documents')})""")
def reports(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    store.append("reports", report_log(spark, sf_dir))
    return store.table("reports").select(
        "id", "dataset_id", "report_type", "markdown_content", "pdf_path", "tokens_used")


@query("active_dataset_count", f"""select count(*) as active_datasets
  from ({newest_sql(DATASET_LOG)}) where status = 'ready'""")
def active_datasets(spark, sf_dir):
    return active_dataset_count(newest(from_events(spark, sf_dir, DATASET_LOG)))
