"""Stored tables: Parquet partitioned by dataset and run, and append-only logs.

A run writes its rows of all tables below its own id and then publishes them
together, by one event of the registry; readers see the rows of the published run
only. So a run that breaks off, at whatever step, changes nothing, and a reader
never meets the tables of two runs. Registry and job log take only appends; the
current state is the newest row per id.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_timestamp, is_time, nan_to_null, ref
from ..functions.paging import page, sorted_by
from ..operators.outliers import stored_context
from ..settings import (
    ANOMALIES_DDL, DATASETS_DDL, JOBS_DDL, METRICS_DDL, MONTH_PAIRS_DDL, QUERY_LOG_DDL, REJECTS_DDL, REPORTS_DDL,
    REQUIRED_COLUMNS, RUNS_DDL, SUBSCRIPTIONS_DDL,
)

DATASET_TABLES = {
    "subscriptions": SUBSCRIPTIONS_DDL, "metrics": METRICS_DDL, "anomalies": ANOMALIES_DDL, "rejects": REJECTS_DDL,
    "month_pairs": MONTH_PAIRS_DDL,
}
LOG_TABLES = {
    "datasets": DATASETS_DDL, "jobs": JOBS_DDL, "query_log": QUERY_LOG_DDL, "reports": REPORTS_DDL,
    "runs": RUNS_DDL,
}
TABLES = DATASET_TABLES | LOG_TABLES
DELETED = "deleted"
# Parameter: published runs of a dataset that are kept: the current one, and the one that readers may still be at.
KEPT_RUNS = 2


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def to_table(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its types: others are dropped, absent ones null.

    NaN is stored as null; ids and creation times are made where absent. A value
    that its column cannot hold, and a null in a required column that `df` has, end the job.
    """
    df = nan_to_null(df)
    columns = []
    for f in table_schema(table).fields:
        if f.name in df.columns:
            dtype = df.schema[f.name].dataType
            if is_time(f.dataType):
                value = as_timestamp(ref(f.name), dtype)
            elif f.dataType == dtype:
                value = ref(f.name)
            else:
                value = ref(f.name).try_cast(f.dataType)
                value = F.when(value.isNull() & ref(f.name).isNotNull(), F.raise_error(F.concat(
                    F.lit(f"{table}.{f.name} cannot hold "), ref(f.name).cast("string")))).otherwise(value)
        elif f.name == "id":
            value = F.uuid()
        elif f.name in ("created_at", "updated_at"):
            value = F.localtimestamp()
        else:
            value = F.lit(None).cast(f.dataType)
        if f.name in df.columns and f.name in REQUIRED_COLUMNS.get(table, ()):
            value = F.coalesce(value, F.raise_error(F.lit(f"{table}.{f.name} is null")).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns)


def _constant(value: object) -> Column:
    """A literal; times go in as text, which no time zone can shift."""
    return F.lit(str(value) if isinstance(value, datetime) else value)


# Fields that a later event need not repeat: they keep their newest value that isn't null.
CARRIED = ("name", "domain", "source_type", "etl_config", "dataset_id", "run_id")


def newest(log: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The current state per id of an append-only log, combined before the shuffle.

    That is the newest row, with the oldest creation time and the carried fields
    of earlier rows where the newest has none.
    """
    rest = [c for c in log.columns if c != key]
    when = F.struct(at, *rest)
    carried = [c for c in rest if c in CARRIED]
    states = log.groupBy(key).agg(
        F.max_by(F.struct(*rest), when).alias("state"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(f"kept_{c}") for c in carried],
        *([F.min("created_at").alias("kept_created_at")] if "created_at" in rest else []))
    return states.select(key, *[
        (F.col(f"kept_{c}") if f"kept_{c}" in states.columns else F.col(f"state.{c}")).alias(c) for c in rest])


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop_path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _stored(self, name: str) -> DataFrame | None:
        """All rows in the files of a table; of a dataset table those of every run, with `run_id`."""
        schema = table_schema(name)
        if name in DATASET_TABLES:
            schema = schema.add("run_id", T.StringType())
        files, target = self._hadoop_path(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name)) if files.exists(target) else None

    def table(self, name: str) -> DataFrame:
        """The stored rows; an unwritten table is empty. Of a dataset table, those of each dataset's published run.

        The runs are broadcast: each is a folder that the driver lists anyway,
        while a join by their ids would bring a dataset's rows into one task.
        """
        stored = self._stored(name)
        if stored is None:
            return self.spark.createDataFrame([], table_schema(name))
        if name not in DATASET_TABLES:
            return stored
        return stored.join(F.broadcast(self.current_runs(name)), ["dataset_id", "run_id"], "left_semi").select(
            *table_schema(name).fieldNames())

    # Runs

    def _published(self, table: str) -> DataFrame:
        """dataset_id, run_id and time of each publication of a dataset table."""
        whole = self.table("datasets").filter("run_id is not null and status = 'ready'").select(
            F.col("id").alias("dataset_id"), "run_id", F.col("updated_at").alias("published_at"))
        own = self.table("runs").filter(F.col("table_name") == table).select("dataset_id", "run_id", "published_at")
        return whole.unionByName(own)

    def current_runs(self, table: str) -> DataFrame:
        """dataset_id and run_id: the runs whose rows of the table readers see.

        That is one, and those that have only added rows to it since.
        """
        return self._published(table).groupBy("dataset_id").agg(
            F.max_by("run_id", F.struct("published_at", "run_id")).alias("run_id")).select(
            "dataset_id", F.explode(F.split("run_id", ",")).alias("run_id"))

    def publish(self, dataset_id: str, tables: dict[str, str]) -> None:
        """Make runs (several with commas between) those that readers see of these tables, by one event."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.append_rows("runs", *(
            {"dataset_id": dataset_id, "table_name": t, "run_id": runs, "published_at": now} for t, runs in tables.items()))

    def write_run(self, table: str, df: DataFrame, run_id: str, one_dataset: bool = False) -> None:
        """Write rows of a run that isn't published yet; nobody reads them.

        Rows of several datasets are first brought together by dataset, a large
        one being split over tasks, so that no task writes a file to each.
        """
        rows = df if one_dataset else df.hint("rebalance", F.col("dataset_id"))
        (to_table(rows, table).withColumn("run_id", F.lit(run_id))
         .write.partitionBy("dataset_id", "run_id").mode("append").parquet(self.path(table)))

    def drop_run(self, dataset_id: str, run_id: str) -> None:
        """Remove what a run has written of a dataset."""
        for table in DATASET_TABLES:
            files, target = self._hadoop_path(f"{self._dataset_path(table, dataset_id)}/run_id={run_id}")
            files.delete(target, True)

    def drop_old_runs(self, dataset_id: str, keep: int = KEPT_RUNS) -> None:
        """Remove the files of a dataset's published runs but the newest `keep`.

        Runs that were never published are left: they may be under way.
        """
        for table in DATASET_TABLES:
            files, target = self._hadoop_path(self._dataset_path(table, dataset_id))
            if not files.exists(target):
                continue
            there = {x.getPath().getName().removeprefix("run_id=") for x in files.listStatus(target)}
            mine = self._published(table).filter(F.col("dataset_id") == dataset_id)
            kept = mine.groupBy("run_id").agg(F.max("published_at").alias("at")).orderBy(
                F.desc("at"), F.desc("run_id")).limit(keep).select(F.explode(F.split("run_id", ",")).alias("run_id"))
            old = mine.select(F.explode(F.split("run_id", ",")).alias("run_id")).filter(
                F.col("run_id").isin(*there)).distinct().join(kept, "run_id", "left_anti")
            for row in old.collect():  # few: those since the last call
                files.delete(self._hadoop_path(f"{self._dataset_path(table, dataset_id)}/run_id={row['run_id']}")[1], True)

    # Dataset tables

    def replace(
        self, table: str, df: DataFrame, one_dataset: bool = False, datasets: tuple[str, ...] = (),
        run_id: str | None = None,
    ) -> None:
        """Write the rows; each dataset among them replaces its old rows.

        A dataset without rows leaves nothing to replace: name it in `datasets`.
        With `run_id` the rows belong to that run, and count once it is published.
        """
        if run_id is not None:
            self.write_run(table, df, run_id, one_dataset)
            return
        run_id = str(uuid.uuid4())
        self.write_run(table, df, run_id, one_dataset)
        written = self._stored(table).filter(F.col("run_id") == run_id).select("dataset_id")
        named = self.spark.createDataFrame([(d,) for d in datasets], "dataset_id string")
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.append("runs", written.unionByName(named).distinct().select(
            "dataset_id", F.lit(table).alias("table_name"), F.lit(run_id).alias("run_id"),
            _constant(now).cast("timestamp_ntz").alias("published_at")))

    def write_subscriptions(
        self, df: DataFrame, one_dataset: bool = False, datasets: tuple[str, ...] = (), run_id: str | None = None,
    ) -> None:
        self.replace("subscriptions", df, one_dataset, datasets, run_id)

    def write_metrics(
        self, df: DataFrame, one_dataset: bool = False, datasets: tuple[str, ...] = (), run_id: str | None = None,
    ) -> None:
        self.replace("metrics", df, one_dataset, datasets, run_id)

    def write_anomalies(
        self, df: DataFrame, one_dataset: bool = False, datasets: tuple[str, ...] = (),
        context_chars: int | None = None, run_id: str | None = None,
    ) -> None:
        """Store anomalies with their whole row context, or its first `context_chars` characters."""
        rows = df.withColumn("row_context", stored_context(F.col("row_context"), context_chars))
        self.replace("anomalies", rows, one_dataset, datasets, run_id)

    def write_rejects(
        self, df: DataFrame, one_dataset: bool = False, datasets: tuple[str, ...] = (), run_id: str | None = None,
    ) -> None:
        """Store what a run could not take: skipped lines, and values that were lost."""
        self.replace("rejects", df, one_dataset, datasets, run_id)

    def _dataset_path(self, table: str, dataset_id: str) -> str:
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils \
            .escapePathName(dataset_id)
        return f"{self.path(table)}/dataset_id={name}"

    def delete(self, dataset_id: str, tables: tuple[str, ...] = tuple(DATASET_TABLES)) -> None:
        """Drop the dataset's partitions, of all runs; no other data is read or written."""
        for table in tables:
            files, target = self._hadoop_path(self._dataset_path(table, dataset_id))
            files.delete(target, True)

    def delete_dataset(self, dataset_id: str) -> None:
        """Remove a dataset with everything that belongs to it.

        Its jobs and reports are hidden by the appended mark.
        """
        self.delete(dataset_id)
        last = newest(self.table("datasets").filter(F.col("id") == dataset_id))
        self.append("datasets", last.withColumn("status", F.lit(DELETED))
                    .withColumn("updated_at", F.localtimestamp()))

    # Logs

    def append(self, table: str, df: DataFrame) -> None:
        to_table(df, table).write.mode("append").parquet(self.path(table))

    def append_rows(self, table: str, *rows: dict) -> None:
        """Append a few events made by the program itself."""
        fields = table_schema(table)
        names = sorted({k for r in rows for k in r})
        events = F.array(*[
            F.struct(*[_constant(r.get(n)).cast(fields[n].dataType).alias(n) for n in names])
            for r in rows
        ])
        self.append(table, self.spark.range(0, 1, 1, 1).select(F.inline(events)))

    def datasets(self) -> DataFrame:
        """Current registry without deleted datasets."""
        return newest(self.table("datasets")).filter(F.col("status") != DELETED)

    def _of_existing(self, rows: DataFrame) -> DataFrame:
        """Without the rows of deleted datasets."""
        gone = self.table("datasets").filter(F.col("status") == DELETED).select(F.col("id").alias("dataset_id"))
        return without_datasets(rows, gone.distinct())

    def jobs(self) -> DataFrame:
        """Current state of the jobs of all datasets that exist."""
        return self._of_existing(newest(self.table("jobs")))

    def job(self, job_id: str) -> DataFrame:
        """Current state of one job."""
        return self._of_existing(newest(self.table("jobs").filter(F.col("id") == job_id)))

    def reports(self) -> DataFrame:
        return self._of_existing(self.table("reports"))

    def report(self, report_id: str) -> DataFrame:
        return self.reports().filter(F.col("id") == report_id)

    def sql_tables(self) -> dict[str, DataFrame]:
        """The tables a given statement may name."""
        return {
            "saas_subscriptions": self.table("subscriptions"),
            "saas_metrics": self.table("metrics"),
            "anomaly_records": self.table("anomalies"),
        }


# --- Registry and log queries ------------------------------------------------

DATASET_ORDER = (("created_at", False), ("id", False))
HISTORY_ORDER = (("created_at", True), ("id", True))


def dataset_list(datasets: DataFrame, skip: int = 0, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """A page of the registry, by offset or behind a cursor of DATASET_ORDER."""
    if cursor is not None:
        return page(datasets, DATASET_ORDER, limit, cursor)
    return datasets.orderBy(*sorted_by(DATASET_ORDER)).offset(skip).limit(limit)


def taken_names(names: DataFrame, datasets: DataFrame) -> DataFrame:
    """Of the wanted names, those a ready dataset already has."""
    ready = datasets.filter("status = 'ready'").select("name")
    return names.join(ready, "name", "left_semi")


def without_datasets(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of datasets that are not deleted."""
    return table.join(deleted.select("dataset_id"), "dataset_id", "left_anti")


def query_history(log: DataFrame, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """The newest queries, or the newest behind a cursor of HISTORY_ORDER."""
    return page(log, HISTORY_ORDER, limit, cursor)


def active_dataset_count(datasets: DataFrame) -> DataFrame:
    return datasets.agg(F.count_if(F.col("status") == "ready").alias("active_datasets"))
