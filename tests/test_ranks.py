import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.ranks import interpolate, order_statistics, quantile_ranks, sketch


def _ranks(spark, values, wanted, limit):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    seen = df.agg(F.count("x").alias("n"), sketch(F.col("x")).alias("g")).first()
    return order_statistics(df, {"x": wanted}, {"x": seen["n"]}, {"x": seen["g"]}, limit)


@pytest.mark.parametrize("limit", [10, 400, 10**6])
def test_ranks_are_exact_at_every_gather_limit(spark, limit):
    rng = random.Random(3)
    values = [rng.lognormvariate(2, 3) for _ in range(4000)]
    values += [7.0] * 3000 + [9.0] * 2500 + [float("inf")] * 3 + [-1e300] * 2
    ordered = sorted(values)
    hot = ordered.index(7.0)
    wanted = [0, 1, 2, 3, hot - 1, hot, hot + 2999, hot + 3000, len(values) // 2,
              len(values) - 4, len(values) - 1, *rng.sample(range(len(values)), 8)]
    found = _ranks(spark, values + [None] * 50, wanted, limit)
    assert {r: found["x", r] for r in wanted} == {r: ordered[r] for r in wanted}


def test_a_third_of_the_rows_in_one_value(spark):
    values = [5.0] * 2000 + [float(i) for i in range(100, 4100)]
    ordered = sorted(values)
    wanted = [0, 1999, 2000, 3000, 5999]
    found = _ranks(spark, values, wanted, 20)
    assert [found["x", r] for r in wanted] == [ordered[r] for r in wanted]


def test_interpolation():
    values = [1.0, 2.0, 4.0, 8.0]
    assert interpolate(4, 0.25, values.__getitem__) == 1.75
    assert interpolate(4, 0.5, values.__getitem__) == 3.0
    assert interpolate(0, 0.5, values.__getitem__) is None
    assert quantile_ranks(1, 0.75) == [0]
