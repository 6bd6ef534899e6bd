"""One run: read, map, clean, derive, label, check, store, detect."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.scratch import stage, stage_counted, staging
from ..operators.checks import validation_report
from ..operators.clean import OUTSIDE, CleanReport, CleanResult, clean
from ..operators.derive import transform_subscriptions
from ..operators.enrich import Classifier, enrich, enrich_with_model, label_counts, label_report
from ..operators.outliers import anomalies, explain_anomalies, row_key
from ..operators.profile import apply_mapping, canonical_mapping, detect_domain
from ..operators.snapshot import has_months, month_pairs, snapshots
from ..settings import CANONICAL_HINTS, DATE_FORMATS, REJECT_DATE
from ..sources.readers import ROW_INDEX, Landed, land_source
from ..sources.store import Store

# Canonical columns that are empty for most rows by nature.
SPARSE = ("churn_date", "churn_reason")


@dataclass
class EtlRun:
    dataset_id: str
    rows_processed: int
    rows_final: int
    anomalies_found: int
    validation_passed: bool
    status: str
    cleaning: CleanReport
    validation: DataFrame
    enrichment: DataFrame
    lines_skipped: int = 0

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.dataset_id, self.rows_processed, self.rows_final, self.anomalies_found,
              self.validation_passed, self.status)],
            "dataset_id string, rows_processed bigint, rows_final bigint, "
            "anomalies_found bigint, validation_passed boolean, status string")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def canonical_table(df: DataFrame) -> tuple[DataFrame, str]:
    """The table under canonical headers, and its domain."""
    mapping = canonical_mapping(df.columns)
    return apply_mapping(df, mapping), detect_domain(df.columns)


def label(
    derived: DataFrame, max_enriched: int | None = None, key: tuple[str, ...] = (),
    models: dict[str, Callable[[], Classifier]] | None = None,
) -> DataFrame:
    """Labels by rules, and by a model for the fields that have one."""
    labelled = enrich(derived, max_enriched, key)
    for name, make_classifier in (models or {}).items():
        labelled = enrich_with_model(labelled.drop(name), name, make_classifier)
    return labelled


def rejected(spark: SparkSession, landed: Landed, cleaned: CleanResult) -> DataFrame | None:
    """What a run could not take, by the record's number: lines that are no rows, and dates that are none."""
    parts = []
    if landed.rejects is not None:
        parts.append(landed.rejects.withColumnRenamed(ROW_INDEX, "row_index"))
    if cleaned.lost_dates is not None:
        parts.append(cleaned.lost_dates.withColumnRenamed(ROW_INDEX, "row_index").withColumn("reason", F.lit(REJECT_DATE)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def write_months(store: Store, dataset_id: str, ready: DataFrame, run_id: str) -> None:
    """The metrics of the rows, and what they were counted from, to which later rows can be added."""
    mine = F.lit(dataset_id)
    if has_months(ready):
        pairs = stage(month_pairs(ready, exact=True), "pairs")
        store.replace("month_pairs", pairs.withColumn("dataset_id", mine), one_dataset=True, run_id=run_id)
        months = snapshots(ready, pairs=pairs)
    else:
        months = snapshots(ready)
    store.write_metrics(stage(months.withColumn("dataset_id", mine), "months"), one_dataset=True, run_id=run_id)


def run_etl(
    spark: SparkSession, store: Store, dataset_id: str, kind: str, name: str | None = None,
    job_id: str | None = None, detect: bool = True, max_enriched: int | None = None,
    key: tuple[str, ...] = (), models: dict[str, Callable[[], Classifier]] | None = None,
    explain: Callable[[], Classifier] | None = None, date_formats: tuple[str, ...] = DATE_FORMATS, **source,
) -> EtlRun:
    """Run every stage for one source and store the results.

    A failed quality check is recorded and does not stop the run; an error marks
    job and dataset as failed and is raised again. `key` names columns that
    identify a row, for the anomalies, which also have the record's number in
    the source. `models` and `explain` make clients that label rows and explain
    anomalies. What the run has staged is removed at its end; frames in the
    result are read before that.

    All tables are written below the run's own id, and the registry's last event
    publishes them together: a run that breaks off leaves the tables as they
    were. Rows, labels, caps and anomalies are counted while they are written.
    """
    job_id = job_id or str(uuid.uuid4())
    run_id = str(uuid.uuid4())
    name = name or dataset_id
    started = _now()

    def log(status: str, progress: int, step: str, **more) -> None:
        store.append_rows("jobs", {
            "id": job_id, "dataset_id": dataset_id, "status": status, "progress": progress,
            "stage": step, "started_at": started, "created_at": started, "updated_at": _now(),
            **more})

    def register(status: str, **more) -> None:
        store.append_rows("datasets", {
            "id": dataset_id, "name": name, "source_type": kind, "status": status,
            "created_at": started, "updated_at": _now(), **more})

    step, publishing = "fetching", False
    with staging(spark, f"run-{job_id}"):
        try:
            log("processing", 5, step)
            landed = land_source(spark, kind, **source)
            step = "schema_detection"
            log("processing", 15, step)
            table, domain = canonical_table(landed.frame)
            step = "cleaning"
            log("processing", 25, step)
            cleaned = clean(
                table, protect=tuple(c for c in SPARSE if c in CANONICAL_HINTS), date_formats=date_formats,
                row_index=ROW_INDEX)
            rows, capped = cleaned.counted()
            step = "transforming"
            log("processing", 40, step)
            derived = transform_subscriptions(rows, dataset_id)
            step = "enrichment"
            log("processing", 55, step)
            # Metrics, checks, anomalies and the sink all read this one table.
            labelled = label(derived, max_enriched, key, models)
            prepared, seen = stage_counted(labelled, "prepared", *label_counts(labelled.columns), *capped)
            ready, cleaning = prepared.drop(OUTSIDE), cleaned.with_counts(seen)
            step = "validation"
            log("processing", 70, step)
            report = validation_report(ready, domain)
            findings = report.collect()  # one row per rule
            passed = all(r["passed"] for r in findings)
            step = "storing"
            log("processing", 80, step)
            store.write_subscriptions(ready, one_dataset=True, run_id=run_id)
            write_months(store, dataset_id, ready, run_id)
            lost = rejected(spark, landed, cleaned)
            if lost is not None:
                store.write_rejects(lost.withColumn("dataset_id", F.lit(dataset_id)), one_dataset=True, run_id=run_id)
            found = 0
            step = "anomaly_detection"
            if detect:
                log("processing", 90, step)
                # As stored: numbers after capping, context from the numeric columns.
                context = [c for c in numeric_columns(ready) if c != ROW_INDEX]
                numbers = ready.select(*dict.fromkeys([*key, *context]), ROW_INDEX)
                cells = anomalies(numbers, keep=(*key, ROW_INDEX), context=context)
                cells = cells.withColumns({"row_key": row_key(key), "dataset_id": F.lit(dataset_id)})
                if explain is not None:
                    cells = explain_anomalies(cells, name, ["row_context"], explain)
                cells, met = stage_counted(
                    cells.withColumnRenamed(ROW_INDEX, "row_index"), "anomalies", F.count(F.lit(1)).alias("cells"))
                found = met["cells"]
                store.write_anomalies(cells, one_dataset=True, run_id=run_id)
            failures = [r.asDict() for r in findings if r["outcome"] != "passed"]
            labels = label_report(seen)
            counts = max((labelled for _, _, labelled, _ in labels), default=0)
            share = sum(r["passed"] for r in findings) / len(findings) if findings else 1.0
            log("completed", 100, "done", finished_at=_now(), rows_processed=cleaning.original_rows,
                rows_cleaned=cleaning.final_rows, rows_enriched=counts)
            publishing = True
            register(
                "ready", run_id=run_id, domain=domain, row_count=cleaning.original_rows,
                column_count=len(table.columns) - 1, validation_report=json.dumps(
                    {"passed": passed, "pass_rate": round(share, 4), "findings": failures,
                     "cleaning": {**cleaning.stored(), "lines_skipped": landed.rejected}}, default=str))
        except Exception as error:
            if not publishing:
                store.drop_run(dataset_id, run_id)
            log("failed", 0, step, finished_at=_now(), error_message=str(error))
            register("failed", error_message=str(error))
            raise
    store.drop_old_runs(dataset_id)
    return EtlRun(
        dataset_id, cleaning.original_rows, cleaning.final_rows, found, passed, "completed", cleaning,
        spark.createDataFrame(findings, report.schema),
        spark.createDataFrame(labels, "rows bigint, field string, labelled bigint, fallbacks bigint"), landed.rejected)
