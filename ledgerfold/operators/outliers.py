"""Anomalies by z-score and interquartile range, and their explanations' prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, numeric_columns, ref
from ..functions.ranks import interpolate, order_statistics, quantile_ranks, sketch
from ..functions.scratch import stage
from ..settings import (
    ANOMALY_IQR_MULTIPLIER, ANOMALY_MIN_VALUES, ANOMALY_SKIP, ANOMALY_Z_LIMIT,
    EXPECTED_RANGE, PROMPT_CONTEXT_ITEMS, SEVERITY_HIGH_Z, SEVERITY_MEDIUM_Z,
)
from .enrich import Classifier, batch_classify


@dataclass(frozen=True)
class Baseline:
    """What is usual in a column; fences only where they were asked for."""

    mean: float
    std: float
    low: float | None = None
    high: float | None = None


def anomaly_columns(df: DataFrame, skip: tuple[str, ...] = ANOMALY_SKIP) -> list[str]:
    """Numeric columns whose name has none of the skipped parts."""
    return [c for c in numeric_columns(df) if not any(part in c.lower() for part in skip)]


def baselines(
    df: DataFrame, columns: list[str], multiplier: float = ANOMALY_IQR_MULTIPLIER, fences: bool = True,
) -> dict[str, Baseline]:
    """Mean, deviation and fences; columns too short or constant are left out.

    One pass for all columns together gives moments and counts, exact ranks take
    more where fences are wanted. Only a few numbers per column come back to the
    driver.
    """
    if not columns:
        return {}
    doubles = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    seen = doubles.agg(*[
        a for i in range(len(columns)) for a in (
            F.count(f"c{i}").alias(f"n{i}"), F.avg(f"c{i}").alias(f"m{i}"),
            F.stddev_samp(f"c{i}").alias(f"s{i}"),
            *([sketch(F.col(f"c{i}")).alias(f"g{i}")] if fences else []),
        )
    ]).first()
    usable = [
        i for i in range(len(columns))
        if seen[f"n{i}"] >= ANOMALY_MIN_VALUES and seen[f"s{i}"] != 0
    ]
    if not fences:
        return {columns[i]: Baseline(seen[f"m{i}"], seen[f"s{i}"]) for i in usable}
    found = order_statistics(
        doubles,
        {f"c{i}": [r for q in (0.25, 0.75) for r in quantile_ranks(seen[f"n{i}"], q)] for i in usable},
        {f"c{i}": seen[f"n{i}"] for i in usable}, {f"c{i}": seen[f"g{i}"] for i in usable},
    )
    result = {}
    for i in usable:
        n = seen[f"n{i}"]
        q1, q3 = (interpolate(n, q, lambda r: found[f"c{i}", r]) for q in (0.25, 0.75))
        margin = multiplier * (q3 - q1)
        result[columns[i]] = Baseline(seen[f"m{i}"], seen[f"s{i}"], q1 - margin, q3 + margin)
    return result


def z_score(c: Column, b: Baseline) -> Column:
    return F.abs((c.cast("double") - F.lit(b.mean)) / F.lit(b.std))


def _severity(z: Column) -> Column:
    return (F.when(z > SEVERITY_HIGH_Z, F.lit("high"))
            .when(z > SEVERITY_MEDIUM_Z, F.lit("medium")).otherwise(F.lit("low")))


def _find(
    df: DataFrame, keep: tuple[str, ...], usual: dict[str, Baseline], z_limit: float,
    context: list[str],
) -> DataFrame:
    """One row per anomalous cell.

    The limits are constants of the plan: a single scan tests every column of a
    row, and only rows with a hit are taken apart.
    """
    cells, hits = [], []
    for name, b in usual.items():
        value = ref(name).cast("double")
        z = z_score(ref(name), b)
        by_z = z > z_limit
        by_range = (value < F.lit(b.low)) | (value > F.lit(b.high))
        hits.append(by_z | by_range)
        cells.append(F.struct(
            F.lit(name).alias("column_name"),
            F.when(by_z & by_range, F.lit("zscore+iqr")).when(by_z, F.lit("zscore"))
            .when(by_range, F.lit("iqr")).alias("method"),
            value.alias("value"), z.alias("score"), _severity(z).alias("severity"),
            F.lit(EXPECTED_RANGE % (b.low, b.high)).alias("expected_range"),
        ))
    rows = df.filter(reduce(lambda a, b: a | b, hits))
    row_context = F.to_json(F.struct(*map(ref, context)), {"ignoreNullFields": "false"})
    return (
        rows.select(*keep, row_context.alias("row_context"), F.inline(F.array(*cells)))
        .filter("method is not null")
    )


def anomalies(
    df: DataFrame, keep: tuple[str, ...] = (), columns: list[str] | None = None,
    z_limit: float = ANOMALY_Z_LIMIT, multiplier: float = ANOMALY_IQR_MULTIPLIER,
    context: list[str] | None = None, known: dict[str, Baseline] | None = None,
) -> DataFrame:
    """Anomalous cells with method, score, severity, expected range and row context.

    `known` tells what is usual, such as merged statistics do; then one scan finds
    the cells, and no pass is made before.

    `keep` names the columns that identify a row. A row number would need a
    total order over the table; a key of the data says the same.
    """
    df = nan_to_null(df)
    names = anomaly_columns(df.drop(*keep)) if columns is None else columns
    usual = baselines(df, names, multiplier) if known is None else {c: known[c] for c in names if c in known}
    context = context or [c for c in df.columns if c not in keep] or df.columns
    if not usual:
        empty = df.limit(0).select(*keep)
        return empty.withColumns({
            "row_context": F.lit(""), "column_name": F.lit(""), "method": F.lit(""),
            "value": F.lit(0.0), "score": F.lit(0.0), "severity": F.lit(""),
            "expected_range": F.lit(""),
        })
    return _find(df, keep, usual, z_limit, context)


def zscore_anomalies(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows far from the mean in deviations."""
    df = nan_to_null(df)
    b = baselines(df, [column], fences=False)
    if not b:
        return df.limit(0).select(*keep, column, F.lit(0.0).alias("score"))
    score = z_score(ref(column), b[column])
    return df.filter(score > ANOMALY_Z_LIMIT).select(*keep, column, score.alias("score"))


def iqr_anomalies(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows outside the fences; the comparison reaches the scan as constants."""
    b = baselines(nan_to_null(df), [column])
    if not b:
        return df.limit(0).select(*keep, column)
    low, high = b[column].low, b[column].high
    value = ref(column)  # NaN counts as larger than any number, also than infinity
    above = (value > F.lit(high)) & (value <= F.lit(float("inf")))
    return df.filter((value < F.lit(low)) | above).select(*keep, column)


def stored_context(c: Column, chars: int | None = None) -> Column:
    """The row context as it is stored: whole, or its first characters if a limit is asked for."""
    return c if chars is None else F.substring(c, 1, chars)


def row_key(keep: tuple[str, ...]) -> Column:
    """The key columns of a row as JSON, by which a stored anomaly finds its row again."""
    return F.to_json(F.struct(*map(ref, keep)), {"ignoreNullFields": "false"}) if keep else F.lit(None).cast("string")


def explain_anomalies(
    found: DataFrame, dataset_name: str, context: list[str], make_explainer: Callable[[], Classifier],
    tasks: int | None = None,
) -> DataFrame:
    """`found` with `llm_explanation`: the model's answer to each anomaly's prompt.

    Equal prompts are asked once, spread over `tasks` tasks, and their answers
    stored before they are used. A prompt that fails leaves a null.
    """
    asked = found.withColumn("prompt_", anomaly_prompt(found, dataset_name, context))
    prompts = asked.select(F.col("prompt_").alias("prompt")).filter("prompt is not null").distinct().repartition(
        tasks or found.sparkSession.sparkContext.defaultParallelism, "prompt")
    answers = stage(batch_classify(prompts, make_explainer).select(
        F.sha2("prompt", 256).alias("prompt_key_"), F.col("reply").alias("llm_explanation")), "explanations")
    rows = asked.withColumn("prompt_key_", F.sha2("prompt_", 256)).drop("prompt_", "llm_explanation")
    return rows.join(answers, "prompt_key_", "left").drop("prompt_key_")


def anomaly_prompt(found: DataFrame, dataset_name: str, context: list[str]) -> Column:
    """Text that asks a model to explain one anomaly; `context` must be columns of `found`."""
    few = F.to_json(F.struct(*map(ref, context[:PROMPT_CONTEXT_ITEMS])),
                    {"ignoreNullFields": "false"})
    return F.concat(
        F.lit("Explain the following data anomaly to a subscription business.\n"
              f"Dataset {dataset_name}, column "), F.col("column_name"),
        F.lit(": value "), F.col("value").cast("string"),
        F.lit(", usual range "), F.col("expected_range"),
        F.lit(", found by "), F.col("method"),
        F.lit(" with score "), F.format_string("%.2f", F.col("score")),
        F.lit(".\nRow: "), few,
        F.lit("\nAnswer in two or three sentences: likely cause and what to check."),
    )
