"""Files of an export that a run reads."""

from pyspark.sql import functions as F

from ledgerfold.plans.run_queries import _in_files


def test_exports_have_as_many_files_as_the_session_has_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, files in (("20", 20), ("2", 5)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = _in_files(spark.range(1000, 0, -1), 5, "id").select("id", F.spark_partition_id().alias("p")).collect()
            assert [r["id"] for r in rows] == list(range(1, 1001)) and len({r["p"] for r in rows}) == files
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
