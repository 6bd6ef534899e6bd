"""What a caller asks of the service: take in a file, answer SQL, write a report."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.serving import (
    dashboard_summary, histogram, job_seconds, metrics_last_n, report_context, report_markdown, safe_sql,
)
from ..settings import ETL_BOUNDS_SECONDS, REPORT_TYPE, SQL_ROW_LIMIT
from ..sources.readers import check_suffix, source_fingerprint
from ..sources.store import Store, taken_names
from .etl import EtlRun, run_etl


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def register_upload(
    store: Store, path: str, name: str, domain: str = "saas", max_bytes: int | None = None,
) -> tuple[str, str]:
    """Enter a delimited file or folder of parts as a pending dataset with a queued job; their ids.

    Refused are other file types, names a ready dataset has, and, if `max_bytes`
    is given, larger files.
    """
    spark = store.spark
    check_suffix(path)
    if max_bytes is not None:  # sizes first: no content is read for them
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        if largest > max_bytes:
            raise ValueError(f"{path} has {largest} bytes, the limit is {max_bytes}")
    wanted = spark.createDataFrame([(name,)], "name string")
    if not taken_names(wanted, store.datasets()).isEmpty():
        raise ValueError(f"a ready dataset is already named {name}")
    dataset_id, job_id, now = str(uuid.uuid4()), str(uuid.uuid4()), _now()
    config = {"filename": PurePosixPath(path).name, "hash": source_fingerprint(spark, path)}
    store.append_rows("datasets", {
        "id": dataset_id, "name": name, "domain": domain, "source_type": "csv",
        "status": "pending", "etl_config": json.dumps(config), "created_at": now, "updated_at": now})
    store.append_rows("jobs", {
        "id": job_id, "dataset_id": dataset_id, "status": "queued", "progress": 0,
        "stage": "queued", "created_at": now, "updated_at": now})
    return dataset_id, job_id


def ingest(
    store: Store, path: str, name: str, domain: str = "saas", max_bytes: int | None = None, **options,
) -> EtlRun:
    """Register a file and run every stage on it.

    `options` are those of the run (key, models, explain, date_formats, ...) and of
    the reader (sep, multiline).
    """
    dataset_id, job_id = register_upload(store, path, name, domain, max_bytes)
    return run_etl(store.spark, store, dataset_id, "csv", name=name, job_id=job_id, path=path, **options)


class Answer(list):
    """The rows of a statement; `truncated` if it has more."""

    truncated = False


def answer(store: Store, question: str, sql: str, strict: bool = False, limit: int = SQL_ROW_LIMIT) -> Answer:
    """Run a read-only statement over the stored tables and log it.

    Statements return at most `limit` rows; a result that was cut there is marked,
    also in the log. A refused or failing statement is logged with its error and
    gives no rows.
    """
    began, rows, error = time.perf_counter(), Answer(), None
    try:
        found = safe_sql(store.spark, sql, store.sql_tables(), strict, limit + 1).collect()
        rows = Answer(found[:limit])
        rows.truncated = len(found) > limit
    except Exception as problem:
        error = str(problem)
    store.append_rows("query_log", {
        "id": str(uuid.uuid4()), "question": question, "generated_sql": sql,
        "result_rows": len(rows), "latency_ms": (time.perf_counter() - began) * 1000, "truncated": rows.truncated,
        "success": error is None, "error_message": error, "created_at": _now()})
    return rows


def metrics_of(store: Store, dataset_id: str, last: int = 24) -> DataFrame:
    """The newest snapshots of a dataset, oldest first."""
    return metrics_last_n(store.table("metrics").filter(F.col("dataset_id") == dataset_id), last)


def anomalies_of(store: Store, dataset_id: str, severity: str | None = None, limit: int = 100) -> tuple[DataFrame, int]:
    """The highest-scored anomalies of a dataset, and how many there are in all."""
    mine = store.table("anomalies").filter(F.col("dataset_id") == dataset_id)
    if severity is not None:
        mine = mine.filter(F.col("severity") == severity)
    return mine.orderBy(F.desc("score"), "id").limit(limit), mine.count()


def dashboard(store: Store) -> DataFrame:
    """Per dataset its registry row, latest snapshot and anomaly counts."""
    datasets = store.datasets().withColumnsRenamed({"id": "dataset_id", "name": "dataset_name"})
    return dashboard_summary(datasets, store.table("metrics"), store.table("anomalies"))


def etl_histogram(store: Store) -> DataFrame:
    """Durations of the finished jobs, by bucket."""
    return histogram(job_seconds(store.jobs()), "seconds", ETL_BOUNDS_SECONDS)


def generate_report(store: Store, dataset_id: str, period: str | None = None) -> DataFrame:
    """The report of a dataset as Markdown, with its id; also appended to the report log.

    The period is a label: the data is always the latest.
    """
    period = period or f"{_now():%Y-%m}"
    mine = F.col("dataset_id") == dataset_id
    context = report_context(
        store.table("subscriptions").filter(mine), store.table("metrics").filter(mine),
        store.table("anomalies").filter(mine), "customer_id", "row_context", period)
    markdown = report_markdown(context)
    report_id = str(uuid.uuid4())
    store.append("reports", markdown.select(
        F.lit(report_id).alias("id"), F.lit(dataset_id).alias("dataset_id"), "period", F.lit(REPORT_TYPE).alias("report_type"),
        F.col("markdown").alias("markdown_content"), F.lit(0).alias("tokens_used")))
    return markdown.withColumn("report_id", F.lit(report_id))
