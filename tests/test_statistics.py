"""Merged statistics against exact ones."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.columns import nan_to_null
from ledgerfold.functions.scratch import is_columnar_scan, stored
from ledgerfold.operators.clean import cap_outliers_iqr, fill_numeric_median
from ledgerfold.operators.outliers import anomalies, baselines
from ledgerfold.operators.statistics import (
    RANK_ERROR, column_statistics, merged_statistics, number_statistics, rank_errors, union_parts, usual,
)


@pytest.fixture(scope="module")
def values(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stat") / "v")
    spark.range(60_000, numPartitions=6).selectExpr(
        "id", "cast(pow(id * 7919 % 10007, 2) as double) as wide", "if(id % 3 = 0, 5.0D, id % 101) as hot",
        "if(id % 11 = 0, null, if(id % 1000 = 1, 'NaN', 1e9 + id % 17)) + 0D as far", "cast(null as double) as none",
        "id % 5 as part", "if(id = 77, 1e12D, id % 13) as spike").write.parquet(path)
    return spark.read.parquet(path)


NAMES = ["wide", "hot", "far", "none", "spike"]


@pytest.mark.parametrize("parts", [1, 5])
def test_merged_moments_are_those_of_all_values(values, parts):
    each = [values if parts == 1 else values.filter(F.col("part") == i) for i in range(parts)]
    found = {r["column_name"]: r for r in merged_statistics(union_parts([column_statistics(p, NAMES) for p in each])).collect()}
    exact = baselines(nan_to_null(values.select(*NAMES)), NAMES, fences=False)
    for name in ("wide", "hot", "far", "spike"):
        s = found[name]
        assert s["rows"] == 60_000 and math.isclose(s["mean"], exact[name].mean, rel_tol=1e-12)
        assert math.isclose((s["m2"] / (s["n"] - 1)) ** 0.5, exact[name].std, rel_tol=1e-6)
    assert found["none"]["n"] == 0 and found["none"]["sketch"] is None and found["none"]["rows"] == 60_000
    assert found["far"]["n"] == values.filter("far is not null and not isnan(far)").count()


def test_rank_error_is_within_its_bound(values):
    merged = merged_statistics(union_parts([column_statistics(values.filter(F.col("part") == i), NAMES) for i in range(5)]))
    errors = rank_errors(values, merged).collect()
    assert len(errors) == 12 and all(r["rank_error"] <= RANK_ERROR for r in errors)


def test_known_statistics_spare_the_passes(values):
    known = merged_statistics(column_statistics(values, NAMES))
    fences = usual(known)
    cells = anomalies(values.select("id", "spike"), keep=("id",), known=fences)
    assert [r["id"] for r in cells.filter("score > 100").collect()] == [77]
    numbers = number_statistics(known)
    filled = fill_numeric_median(values.select("far"), {"far": numbers["far"]})
    assert filled.filter("far is null").count() == 0
    capped = cap_outliers_iqr(values.select("spike"), known={"spike": numbers["spike"]})
    assert capped.agg(F.max("spike")).first()[0] == numbers["spike"].high < 1e12


def test_only_what_is_not_stored_is_stored(spark, values, tmp_path):
    assert is_columnar_scan(values.filter("id > 3").select("id")) and stored(values, "x") is values
    values.limit(5).write.option("header", True).csv(str(tmp_path / "c"))
    for frame in (values.union(values), values.groupBy("part").count(), values.filter(F.rand() < 0.5), spark.range(3),
                  spark.read.option("header", True).csv(str(tmp_path / "c"))):
        assert not is_columnar_scan(frame) and is_columnar_scan(stored(frame, "x"))


def test_no_columns_and_no_rows(spark, values):
    assert merged_statistics(column_statistics(spark.range(0).selectExpr("cast(id as string) as t"))).count() == 0
    found = merged_statistics(column_statistics(values.limit(0), ["wide"])).first()
    assert (found["rows"], found["n"], found["sketch"]) == (0, 0, None)
    assert usual(merged_statistics(column_statistics(values.limit(0), ["wide"]))) == {}
