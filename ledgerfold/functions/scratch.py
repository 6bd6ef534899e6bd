"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_roots: dict[str, str] = {}
_runs: ContextVar[tuple[str, ...]] = ContextVar("runs", default=())


def scratch_root(spark: SparkSession) -> str:
    """Folder of `spark.checkpoint.dir`, shared by driver and executors.

    Only a local session may do without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="ledgerfold-")
    return _local_roots[context.applicationId]


def _session_folder(spark: SparkSession) -> str:
    return "/".join([scratch_root(spark), "ledgerfold", spark.sparkContext.applicationId, *_runs.get()])


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a staged table or folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove everything this session has staged; its staged frames end with it."""
    remove(spark, _session_folder(spark))


@contextmanager
def staging(spark: SparkSession, run: str) -> Iterator[None]:
    """Keep what is staged within the block in a folder of its own, and remove that at the end."""
    outer = _runs.set((*_runs.get(), run))
    try:
        yield
    finally:
        folder = _session_folder(spark)
        _runs.reset(outer)
        remove(spark, folder)


def is_columnar_scan(df: DataFrame) -> bool:
    """Whether `df` is a read of Parquet files under projections and filters: a pass over it reads what it needs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` itself if it is a plain read of Parquet files, else staged."""
    return df if is_columnar_scan(df) else stage(df, label)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and go on from the stored table.

    Cuts the lineage: later passes read only the columns they need and a lost
    executor costs one file split, not the work above.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str, *aggregates: Column) -> tuple[DataFrame, dict[str, object]]:
    """`stage`, with aggregates of the rows that are taken while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, *aggregates), label)
    return staged, seen.get
