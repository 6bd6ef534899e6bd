"""Statistics of numeric columns that are merged instead of taken again.

Each part of a dataset gives one row per column: counts, extremes, mean, sum of
squared deviations, and a KLL sketch of the values. Those of all parts together
come from these rows, so a new part costs a scan of its own rows. Moments and
extremes are those of all values; quantiles have a rank error, which
RANK_ERROR bounds in practice (a sketch draws lots, so it isn't a hard limit).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, numeric_columns, ref
from ..settings import ANOMALY_IQR_MULTIPLIER, ANOMALY_MIN_VALUES, CAP_EXEMPT, CAP_IQR_MULTIPLIER
from .clean import NumberStats
from .outliers import Baseline

# Parameter: values that a sketch keeps about, and the share of the rows by which a quantile's rank may then be off.
SKETCH_SIZE = 2048
RANK_ERROR = 0.005
QUANTILES = (0.25, 0.5, 0.75)


def column_statistics(df: DataFrame, columns: list[str] | None = None, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per column, from one scan: column_name, rows, n, minimum, maximum, mean, m2 and sketch (binary).

    NaN counts as null. A column without values has n 0 and no sketch.
    """
    df = nan_to_null(df)
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], STATISTICS)
    aggregates = []
    for i, c in enumerate(columns):
        value = ref(c).cast("double")
        aggregates += [
            F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
            F.avg(value).alias(f"m{i}"), (F.var_pop(value) * F.count(value)).alias(f"d{i}"),
            F.kll_sketch_agg_double(value, size).alias(f"k{i}")]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *aggregates)
    return seen.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col("rows"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("minimum"),
            F.col(f"hi{i}").alias("maximum"), F.col(f"m{i}").alias("mean"), F.col(f"d{i}").alias("m2"),
            F.when(F.col(f"n{i}") > 0, F.col(f"k{i}")).alias("sketch"))
        for i, c in enumerate(columns)])))


STATISTICS = ("column_name string, rows bigint, n bigint, minimum double, maximum double, mean double, m2 double, sketch binary")


def merged_statistics(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of all parts' rows together, per column (and `by`).

    Two levels of deviation: those within the parts, and those of their means from the whole's.
    """
    keys = [*by, "column_name"]
    filled = parts.filter("n > 0")
    means = filled.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("whole_mean"))
    known = filled.join(means, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.first("whole_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("whole_mean"), 2)).alias("m2"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    rows = parts.groupBy(*keys).agg(F.sum("rows").alias("rows"))
    return rows.join(known, keys, "left").select(
        *keys, "rows", F.coalesce("n", F.lit(0)).alias("n"), "minimum", "maximum", "mean", "m2", "sketch")


def _quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(q))


def _values(statistics: DataFrame) -> dict[str, dict]:
    """The figures of each column; a few numbers for each reach the driver, sketches don't."""
    columns = [F.when(F.col("n") > 0, _quantile(q)).alias(f"q{int(100 * q)}") for q in QUANTILES]
    return {r["column_name"]: r.asDict() for r in statistics.select(
        "column_name", "rows", "n", "minimum", "maximum", "mean", "m2", *columns).collect()}


def usual(statistics: DataFrame, multiplier: float = ANOMALY_IQR_MULTIPLIER) -> dict[str, Baseline]:
    """What is usual in each column, as the exact `baselines` have it but for the quartiles' rank error."""
    found = {}
    for name, s in _values(statistics).items():
        if s["n"] < ANOMALY_MIN_VALUES or not s["m2"]:
            continue
        margin = multiplier * (s["q75"] - s["q25"])
        found[name] = Baseline(s["mean"], (s["m2"] / (s["n"] - 1)) ** 0.5, s["q25"] - margin, s["q75"] + margin)
    return found


def number_statistics(statistics: DataFrame, multiplier: float = CAP_IQR_MULTIPLIER) -> dict[str, NumberStats]:
    """What filling and capping need, from the values that are there."""
    found = {}
    for name, s in _values(statistics).items():
        found[name] = stats = NumberStats(s["rows"], s["n"], s["minimum"], s["maximum"], s["q50"])
        if s["n"] and name.lower() not in CAP_EXEMPT:
            spread = s["q75"] - s["q25"]
            stats.low, stats.high = s["q25"] - multiplier * spread, s["q75"] + multiplier * spread
    return found


def rank_errors(df: DataFrame, statistics: DataFrame) -> DataFrame:
    """column_name, quantile and rank_error: how far the sketch's quantiles are from their place among the values of `df`.

    The error is the distance of the wanted rank from the ranks of the value that
    was given, as a share of the values; copies of that value all count.
    """
    figures = _values(statistics)
    parts = []
    for name, s in figures.items():
        if not s["n"]:
            continue
        for q in QUANTILES:
            guess, value = F.lit(s[f"q{int(100 * q)}"]), ref(name).cast("double")
            parts.append(F.struct(
                F.lit(name).alias("column_name"), F.lit(q).alias("quantile"), F.count_if(value < guess).alias("below"),
                F.count_if(value <= guess).alias("upto"), F.lit(s["n"]).alias("n")))
    # one aggregate for all columns and quantiles
    seen = nan_to_null(df).agg(F.array(*parts).alias("each")).select(F.inline("each"))
    wanted = F.col("quantile") * F.col("n")
    off = F.greatest(F.col("below") - wanted, wanted - F.col("upto"), F.lit(0.0))
    return seen.select("column_name", "quantile", (off / F.col("n")).alias("rank_error"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
