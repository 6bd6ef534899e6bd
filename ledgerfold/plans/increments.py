"""Rows that come to a stored dataset or leave it, without a look at the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stage
from ..operators.snapshot import merge_pairs, month_pairs, snapshot_of_pairs
from ..sources.store import Store


def _runs(store: Store, table: str, dataset_id: str) -> list[str]:
    """The runs that a dataset's rows of a table are in."""
    return [r["run_id"] for r in store.current_runs(table).filter(F.col("dataset_id") == dataset_id).orderBy("run_id").collect()]


def _stored(store: Store, dataset_id: str) -> DataFrame:
    """A dataset's rows, its id a constant: by a column Spark would sort all rows of a task before it writes partitions."""
    mine = store.table("subscriptions").filter(F.col("dataset_id") == dataset_id)
    return mine.withColumn("dataset_id", F.lit(dataset_id))


def _bring_up(store: Store, dataset_id: str, changes: list[tuple[DataFrame, int]], subscriptions: str, run_id: str) -> None:
    """Metrics and pairs of the dataset after the changes, published together with its rows."""
    known = store.table("month_pairs").filter(F.col("dataset_id") == dataset_id).withColumns(
        {c: F.col(c).cast("date") for c in ("s", "c")})
    pairs = stage(merge_pairs([(known, 1), *((month_pairs(rows, exact=True), sign) for rows, sign in changes)]), "pairs")
    mine = F.lit(dataset_id)
    store.replace("month_pairs", pairs.withColumn("dataset_id", mine), one_dataset=True, run_id=run_id)
    store.write_metrics(snapshot_of_pairs(pairs).withColumn("dataset_id", mine), one_dataset=True, run_id=run_id)
    store.publish(dataset_id, {"subscriptions": subscriptions, "month_pairs": run_id, "metrics": run_id})


def append_subscriptions(store: Store, dataset_id: str, rows: DataFrame) -> None:
    """Add prepared rows to a dataset; its metrics are those of all rows.

    Only the new rows are read: the stored pairs of start and churn months, with
    their counts and exact amounts, are added to those of the new rows. Rows and
    metrics become visible together; a failure changes nothing. Values are stored
    as they come: medians and fences of a cleaning are those of a whole run.
    """
    run_id = str(uuid.uuid4())
    new = stage(rows.withColumn("dataset_id", F.lit(dataset_id)), "appended")
    try:
        store.write_subscriptions(new, one_dataset=True, run_id=run_id)
        _bring_up(store, dataset_id, [(new, 1)], ",".join([*_runs(store, "subscriptions", dataset_id), run_id]), run_id)
    except Exception:
        store.drop_run(dataset_id, run_id)
        raise


def remove_subscriptions(store: Store, dataset_id: str, ids: DataFrame, key: str = "customer_id") -> None:
    """Take the rows with these keys (column `key`) out of a dataset; its metrics are those of the rows that stay.

    The rows that stay are written anew, as files cannot lose rows; metrics come
    from the differences that the others make.
    """
    run_id = str(uuid.uuid4())
    mine = _stored(store, dataset_id)
    gone = ids.select(key).distinct()
    try:
        store.write_subscriptions(mine.join(gone, key, "left_anti"), one_dataset=True, run_id=run_id)
        _bring_up(store, dataset_id, [(mine.join(gone, key, "left_semi"), -1)], run_id, run_id)
    except Exception:
        store.drop_run(dataset_id, run_id)
        raise


def compact(store: Store, dataset_id: str) -> None:
    """Write the rows of a dataset that are in many runs to one."""
    run_id = str(uuid.uuid4())
    mine = _stored(store, dataset_id)
    store.write_subscriptions(mine, one_dataset=True, run_id=run_id)
    store.publish(dataset_id, {"subscriptions": run_id})
