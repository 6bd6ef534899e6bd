import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm.common import (
    KEY, filter_table, in_filter, left_join_few, rows_in, rows_not_in, set_in, slices, with_row_key,
)


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 3, 3], [1, 100, 1, 0, 0, 7], [100] * 4])
def test_slices_keep_all_rows_in_order(sizes):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in sizes], pa.string()), "i": list(range(len(sizes)))})
    parts = list(slices(batch, "text", 10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows for p in parts)
    assert all(sum(map(len, p.column("text").to_pylist()[:-1])) <= 10 for p in parts)


def test_slices_with_nulls():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "a", None], pa.string())})
    assert [p.column("text").to_pylist() for p in slices(batch, "text", 1)][0][0] is None


def test_filter_has_all_keys_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bitmap = filter_table(keys, 5000)
    inside = np.array([r["k"] for r in keys.collect()])
    other = np.array([r["k"] for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("k")).collect()])
    assert set_in(bitmap, inside).all() and set_in(bitmap, other).mean() < 0.12
    empty = filter_table(keys.limit(0), 0)
    assert not set_in(empty, other).any()
    test = in_filter(keys, 5000)
    assert keys.filter(test(F.col("k"))).count() == 5000


def test_row_keys_name_rows_of_files_and_of_other_frames(spark, tmp_path):
    spark.range(100, numPartitions=4).selectExpr("id % 10 as v", "id as `_key_row`").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    keys = [{tuple(r) for r in with_row_key(stored).select(*KEY).collect()} for _ in range(2)]
    assert keys[0] == keys[1] and len(keys[0]) == 100
    made = with_row_key(spark.range(50).selectExpr("id % 3 as v"))
    assert made.select(*KEY).distinct().count() == 50 and made.columns == ["v", *KEY]


def test_joins_by_row_key(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = with_row_key(spark.read.parquet(str(tmp_path / "t")))
    marks = rows.filter("id % 7 = 0").select(*KEY, (F.col("id") * 2).alias("double"))
    assert {r["id"]: r["double"] for r in left_join_few(rows, marks).collect()} == {
        i: 2 * i if i % 7 == 0 else None for i in range(1000)}
    assert sorted(r["id"] for r in rows_in(rows, marks).collect()) == list(range(0, 1000, 7))
    assert sorted(r["id"] for r in rows_not_in(rows, marks).collect()) == [i for i in range(1000) if i % 7]
    assert rows_not_in(rows, marks.limit(0)).count() == 1000
