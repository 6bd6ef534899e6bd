"""Serving queries over subscriptions, metrics, anomalies and logs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paging import page
from ..functions.scratch import stage
from ..settings import (
    ANOMALY_LINE, BLOCKED_WORDS, CHURNED_LINE, NO_ANOMALIES, NO_CHURNED, NO_EXPLANATION, NO_TREND,
    SQL_ROW_LIMIT, TREND_HEADER,
)
from .derive import mean_of, money_sum
from .snapshot import monthly_snapshot

SEVERITIES = ("high", "medium", "low")
REPORT_PERIODS = 6


# --- Anomalies ---------------------------------------------------------------

def anomaly_order(key: str) -> tuple[tuple[str, bool], ...]:
    return (("score", True), ("column_name", False), (key, False))


def anomaly_page(
    found: DataFrame, key: str, severity: str | None = None, limit: int = 50, cursor: str | None = None,
) -> DataFrame:
    """Highest scores first, from the first row on or behind a cursor of `anomaly_order`."""
    picked = found.filter(F.col("severity") == severity) if severity else found
    return page(picked, anomaly_order(key), limit, cursor)


def anomaly_top(
    found: DataFrame, key: str, severity: str | None = None, limit: int = 50,
) -> DataFrame:
    """Highest scores first, with the number of matches before the limit."""
    picked = found.filter(F.col("severity") == severity) if severity else found
    total = picked.count()
    return (
        anomaly_page(picked, key, None, limit)
        .withColumn("score", F.round("score", 4)).withColumn("total", F.lit(total).cast("bigint"))
    )


def severity_counts(found: DataFrame) -> DataFrame:
    """One row with a count per severity, zero where there is none."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def top_anomalies(found: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """The report's anomalies: medium and high, best score first."""
    picked = found.filter(F.col("severity").isin("medium", "high"))
    if "llm_explanation" not in picked.columns:
        picked = picked.withColumn("llm_explanation", F.lit(None).cast("string"))
    top = picked.orderBy(F.desc("score"), "column_name", key).limit(limit)
    text = F.coalesce(
        F.substring(F.nullif(F.col("llm_explanation"), F.lit("")), 1, 100), F.lit(NO_EXPLANATION))
    return top.select(
        key, "column_name", "severity", "value", "score",
        F.format_string(ANOMALY_LINE, F.upper("severity"), F.col("column_name"),
                        F.col("value"), text).alias("line"),
    )


# --- Metrics -----------------------------------------------------------------

def _zero_nulls(metrics: DataFrame) -> DataFrame:
    fields = ["mrr", "new_mrr", "churned_mrr", "net_new_mrr", "churn_rate"]
    return metrics.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fields})


def metrics_first_n(metrics: DataFrame, periods: int = 12) -> DataFrame:
    """The oldest periods."""
    return _zero_nulls(metrics.orderBy("period").limit(periods)).orderBy("period")


def metrics_last_n(metrics: DataFrame, periods: int = 6) -> DataFrame:
    """The newest periods, oldest first, with the report's text line."""
    last = metrics.orderBy(F.desc("period")).limit(periods)
    return _zero_nulls(last).withColumn("line", trend_line()).orderBy("period")


def trend_line() -> Column:
    return F.concat_ws(
        " | ", "period", F.concat(F.lit("$"), F.format_number(F.col("mrr").cast("double"), 0)),
        F.concat(F.format_number(F.col("churn_rate") * 100, 1), F.lit("%")),
        F.col("active_customers").cast("string"),
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    latest = _zero_nulls(metrics.orderBy(F.desc("period")).limit(1))
    return latest.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("nrr", "arpu")})


def dashboard_summary(datasets: DataFrame, metrics: DataFrame, found: DataFrame) -> DataFrame:
    """Per dataset: its registry row, latest snapshot and anomaly counts.

    Metrics and anomalies are reduced to one row per dataset before the join.
    """
    fields = ["mrr", "active_customers", "churn_rate", "net_new_mrr"]
    latest = metrics.groupBy("dataset_id").agg(
        F.max_by(F.struct("period", *fields), "period").alias("m"))
    counts = found.groupBy("dataset_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_anomalies") for s in SEVERITIES])
    joined = datasets.join(latest, "dataset_id", "left").join(counts, "dataset_id", "left")
    return joined.select(
        "dataset_id", "dataset_name", "status", "row_count",
        F.col("m.period").alias("latest_period"),
        *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c) for c in fields],
        *[F.coalesce(F.col(f"{s}_anomalies"), F.lit(0)).alias(f"{s}_anomalies")
          for s in SEVERITIES],
    )


def mrr_waterfall(metrics: DataFrame) -> DataFrame:
    """The chart table: gains up, losses down, newest month first."""
    return metrics.select(
        F.to_date(F.concat("period", F.lit("-01"))).alias("month"),
        "new_mrr", (-F.col("churned_mrr")).alias("lost_mrr"), F.col("mrr").alias("total_mrr"),
        (F.col("churn_rate") * 100).alias("churn_percent"),
        "new_customers", (-F.col("churned_customers")).alias("lost_customers"),
        "active_customers",
    ).orderBy(F.desc("month"))


# --- Report ------------------------------------------------------------------

def top_churned(subscriptions: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """Largest churned customers by revenue, with the report's text line."""
    top = (
        subscriptions.filter("churned").orderBy(F.desc_nulls_last("mrr"), key).limit(limit)
    )
    name = F.coalesce(F.nullif(F.col("customer_name"), F.lit("")), F.col("customer_id"))
    reason = F.coalesce(F.nullif(F.col("churn_reason_category"), F.lit("")), F.lit("unknown"))
    mrr = F.format_number(F.coalesce(F.col("mrr"), F.lit(0)).cast("double"), 0)
    return top.select(
        key, name.alias("customer"), "mrr", "plan", reason.alias("reason"),
        F.format_string(CHURNED_LINE, name, mrr, F.col("plan"), reason).alias("line"),
    )


def _lines(top: DataFrame, order: list[Column], empty: str, head: str = "") -> str:
    """Text block of a handful of top-k rows."""
    lines = [r["line"] for r in top.orderBy(*order).select("line").collect()]
    return "\n".join(([head] if head else []) + lines) if lines else empty


def report_context(
    subscriptions: DataFrame, metrics: DataFrame, found: DataFrame, sub_key: str, cell_key: str,
    period: str,
) -> DataFrame:
    """One row: period label, latest metrics as JSON, and the three text blocks."""
    # The few newest rows serve both blocks; metrics made on the fly are evaluated once.
    metrics = stage(metrics.orderBy(F.desc("period")).limit(REPORT_PERIODS), "recent")
    latest = latest_metrics(metrics)
    if latest.isEmpty():
        raise ValueError("this dataset has no metrics yet")
    numbers = ["mrr", "new_mrr", "churned_mrr", "net_new_mrr"]
    doubles = {c: F.col(c).cast("double") for c in numbers}
    fields = ["period", *numbers, "active_customers", "churn_rate", "nrr", "arpu"]
    trend = _lines(metrics_last_n(metrics, REPORT_PERIODS), [F.col("period")], NO_TREND, TREND_HEADER)
    churned = _lines(top_churned(subscriptions, sub_key), [F.desc_nulls_last("mrr"), F.col(sub_key)],
                     NO_CHURNED)
    cells = _lines(top_anomalies(found, cell_key), [F.desc("score"), F.col("column_name"),
                                                    F.col(cell_key)], NO_ANOMALIES)
    return latest.withColumns(doubles).select(
        F.lit(period).alias("period"), F.to_json(F.struct(*fields)).alias("metrics"),
        F.lit(trend).alias("trend"), F.lit(churned).alias("churned_customers"),
        F.lit(cells).alias("anomalies"),
    )


def report_markdown(context: DataFrame) -> DataFrame:
    """The context as a Markdown document."""
    return context.select("period", F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Subscription report "), "period"),
        F.lit("## Key metrics"), F.concat(F.lit("```json\n"), "metrics", F.lit("\n```")),
        F.lit("## Monthly trend"), "trend",
        F.lit("## Top churned customers"), "churned_customers",
        F.lit("## Anomalies"), "anomalies",
    ).alias("markdown"))


# --- Logs --------------------------------------------------------------------

def histogram(df: DataFrame, value: str, bounds: tuple[int, ...]) -> DataFrame:
    """Cumulative counts per upper bound, in one aggregate."""
    counts = df.agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("all"),
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("observations"))
            for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("observations")))
    return counts.select(F.inline(F.array(*rows)))


def label_counts(df: DataFrame, metric: str, label: Column) -> DataFrame:
    return (
        df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("value"))
        .select(F.lit(metric).alias("metric"), "label", "value")
    )


def job_seconds(jobs: DataFrame) -> DataFrame:
    """Durations of the finished jobs."""
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / F.lit(1e6)
    return jobs.select(took.alias("seconds")).filter("seconds is not null")


def ops_counters(
    datasets: DataFrame, jobs: DataFrame, queries: DataFrame, found: DataFrame, reports: DataFrame,
) -> DataFrame:
    """All counters of the service, from its tables."""
    outcome = F.when(F.col("success"), "success").otherwise("error")
    form = F.when(F.col("pdf_path").isNotNull(), "pdf").otherwise("markdown")
    totals = jobs.agg(
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("bigint").alias("rows_processed"),
        F.coalesce(F.sum("rows_enriched"), F.lit(0)).cast("bigint").alias("rows_enriched"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("label"), F.col(c).alias("value"))
        for c in ("rows_processed", "rows_enriched")
    ])))
    return (
        label_counts(datasets, "datasets_ingested", F.col("source_type"))
        .unionByName(label_counts(jobs.filter("status = 'failed'"), "etl_errors", F.col("stage")))
        .unionByName(label_counts(queries, "queries", outcome))
        .unionByName(label_counts(found, "anomalies_detected", F.col("severity")))
        .unionByName(label_counts(reports, "reports_generated", form))
        .unionByName(totals)
    )


# --- Business questions ------------------------------------------------------

def total_active_mrr(subs: DataFrame) -> DataFrame:
    return subs.filter("not churned").agg(
        money_sum(F.col("mrr")).alias("total_mrr"), F.count(F.lit(1)).alias("active_customers"))


def plan_churn(subs: DataFrame) -> DataFrame:
    """Plans by churn rate."""
    return (
        subs.groupBy("plan")
        .agg(F.count_if(F.col("churned")).alias("churned"), F.count(F.lit(1)).alias("customers"))
        .select("plan", mean_of(F.col("churned"), F.col("customers")).alias("churn_rate"))
    )


def highest_plan_churn(subs: DataFrame) -> DataFrame:
    return plan_churn(subs).orderBy(F.desc("churn_rate"), "plan").limit(1)


def top_customers(subs: DataFrame, key: str, limit: int = 5) -> DataFrame:
    return (
        subs.select(key, "customer_id", "customer_name", "plan", "mrr")
        .orderBy(F.desc_nulls_last("mrr"), key).limit(limit)
    )


def churn_share(subs: DataFrame, category: str) -> DataFrame:
    """Percentage of churned rows in one reason category."""
    counts = subs.filter("churned").agg(
        F.count(F.lit(1)).alias("churned"),
        F.count_if(F.col("churn_reason_category") == category).alias("matching"))
    return counts.select(
        "churned", "matching",
        (F.try_divide(F.col("matching").cast("double"), F.col("churned").cast("double")) * 100)
        .alias("percent"),
    )


def mean_lifetime(subs: DataFrame, plan: str | None = None, churned_only: bool = False) -> DataFrame:
    picked = subs.filter(F.col("plan") == plan) if plan else subs
    picked = picked.filter("churned") if churned_only else picked
    # Lifetimes are whole tenths, so their sum is exact in integers.
    tenths = F.sum(F.rint(F.col("lifetime_months") * 10).cast("bigint"))
    return picked.agg(tenths.alias("t"), F.count("lifetime_months").alias("customers")).select(
        "customers",
        F.try_divide(F.col("t").cast("double"), F.col("customers").cast("double") * 10)
        .alias("mean_lifetime_months"),
    )


def country_active(subs: DataFrame) -> DataFrame:
    counts = subs.filter("not churned").groupBy("country").agg(
        F.count(F.lit(1)).alias("active_customers"))
    return counts.orderBy(F.desc("active_customers"), "country").limit(1)


def plan_monthly_churn(subs: DataFrame, plan: str) -> DataFrame:
    months = monthly_snapshot(subs.filter(F.col("plan") == plan))
    return months.select("period", "active_customers", "churned_customers", "churn_rate")


def plan_avg_mrr_active(subs: DataFrame) -> DataFrame:
    sums = subs.filter("not churned").groupBy("plan").agg(
        F.sum("mrr").alias("s"), F.count("mrr").alias("n"))
    return sums.select("plan", mean_of(F.col("s"), F.col("n")).alias("avg_mrr"))


# --- Read-only SQL -----------------------------------------------------------

def clean_sql(raw: str) -> str:
    """Strip code fences and outer blanks."""
    return re.sub(r"```(?:sql)?", "", raw, flags=re.IGNORECASE).strip()


def is_safe_sql(sql: str, strict: bool = False) -> bool:
    """True for a read-only statement.

    Blocked words count as whole words, so that `created_at` may be named, and a
    query may begin with `with`. `strict` refuses any text that contains a
    blocked word, and all but `select`.
    """
    lower = sql.lower().strip()
    if strict:
        return lower.startswith("select") and not any(w in lower for w in BLOCKED_WORDS)
    if not re.match(r"(select|with)\b", lower):
        return False
    return re.search(rf"\b({'|'.join(BLOCKED_WORDS)})\b", lower) is None


# Nodes of an analyzed plan that read nothing, and expressions that reach the JVM, files or foreign code.
READS_NOTHING = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation")
OPEN_EXPRESSIONS = (
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "PythonUDF",
    "ScalaUDF", "PythonUDAF", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "PythonUDTF",
)


def _items(seq) -> list:
    """The members of a sequence of the JVM."""
    return [seq.apply(i) for i in range(seq.size())]


def analyzed_plan(session: SparkSession, sql: str):
    """The resolved plan of a statement, which is not run."""
    state = session._jsparkSession.sessionState()
    skip = session._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    return state.executePlan(state.sqlParser().parsePlan(sql), skip).analyzed()


def _check_expression(expression) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in OPEN_EXPRESSIONS:
        raise ValueError(f"{expression.prettyName()} may not be called")
    for child in _items(expression.children()):
        _check_expression(child)


def check_reads(plan, tables: set[str]) -> None:
    """An error if a resolved plan reads anything but the temporary views `tables`, subqueries included.

    What a name stands for is decided where it stands, as it was resolved there:
    a statement's own name in one place does not open a table of that name in
    another.
    """
    if plan.nodeName() == "View":
        name = plan.desc().identifier()
        if plan.isTempView() and name.database().isEmpty() and name.table().lower() in tables:
            return
        raise ValueError(f"no table {name.unquotedString()}; there are {', '.join(sorted(tables))}")
    children = [*_items(plan.children()), *_items(plan.subqueries())]
    if not children and plan.nodeName() not in READS_NOTHING:
        raise ValueError(f"only the tables {', '.join(sorted(tables))} may be read, not {plan.nodeName()}")
    for expression in _items(plan.expressions()):
        _check_expression(expression)
    for child in children:
        check_reads(child, tables)


def safe_sql(
    spark: SparkSession, raw: str, tables: dict[str, DataFrame], strict: bool = False,
    limit: int = SQL_ROW_LIMIT,
) -> DataFrame:
    """Run a given read-only statement over the named tables, in a session of its own.

    Refused are statements that change something, and those whose resolved plan
    reads anything but the named tables (files, tables of the catalog, other
    views) or calls code outside of SQL. Nothing of a statement runs before that.
    """
    sql = clean_sql(raw)
    if not is_safe_sql(sql, strict):
        raise ValueError("only read-only statements are run")
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        view_in(own, name, df)
    try:
        plan = analyzed_plan(own, sql)
    except AnalysisException as problem:
        raise ValueError(str(problem)) from problem
    check_reads(plan, {t.lower() for t in tables})
    return own.sql(sql).limit(limit)


def view_in(session: SparkSession, name: str, df: DataFrame) -> None:
    """Register a frame of another session as a temporary view."""
    moved = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
        session._jsparkSession, df._jdf.queryExecution().logical())
    moved.createOrReplaceTempView(name)
