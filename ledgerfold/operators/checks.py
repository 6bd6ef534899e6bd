"""Quality rules: every rule of a table is answered by one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, is_missing, is_number, is_text, percent_text, ref
from ..settings import (
    DETAIL_MAX_VALUE, DETAIL_MIN_VALUE, DETAIL_NO_COLUMN, DETAIL_NOT_NULL_RATIO, DETAIL_TRUE_RATIO,
    DETAIL_UNIQUE_RATIO, DETAIL_UNKNOWN_CHECK, SUBSCRIPTION_RULES,
)
from .profile import stack_rows


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    check: str
    limit: float
    severity: str


def rules_for(domain: str) -> list[Rule]:
    return [Rule(*r) for r in SUBSCRIPTION_RULES] if domain == "saas" else []


def _truthy(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        hit = c
    elif is_number(dtype):
        hit = c != F.lit(0)
    elif is_text(dtype):
        hit = F.length(c) > 0
    else:
        hit = c.isNotNull()
    return F.coalesce(hit, F.lit(False))


def _limit_text(limit: float) -> str:
    return f"{limit:,}".replace(",", "")


def _measure(rule: Rule, dtype: T.DataType, sketched: bool) -> Column:
    """The aggregate a rule compares with its limit."""
    c = ref(rule.column)
    rows = F.count(F.lit(1)).cast("double")
    if rule.check == "min_value":
        return F.count_if(as_number(c, dtype) < F.lit(rule.limit)).cast("double")
    if rule.check == "max_value":
        return F.count_if(as_number(c, dtype) > F.lit(rule.limit)).cast("double")
    if rule.check == "not_null_ratio":
        return F.try_divide(F.count_if(~is_missing(rule.column, dtype)).cast("double"), rows)
    if rule.check == "unique_ratio":
        different = F.approx_count_distinct(c, 0.01) if sketched else F.count_distinct(c)
        return different.cast("double") / F.greatest(rows, F.lit(1.0))
    if rule.check == "max_ratio_true":
        return F.try_divide(F.count_if(_truthy(c, dtype)).cast("double"), rows)
    return F.lit(0.0)


def _verdict(rule: Rule, m: Column) -> tuple[Column, Column]:
    """Whether the rule holds, and the text that says what was found."""
    if rule.check in ("min_value", "max_value"):
        text = DETAIL_MIN_VALUE if rule.check == "min_value" else DETAIL_MAX_VALUE
        found, holds = m.cast("bigint").cast("string"), m == 0
        return holds, F.format_string(text, found, F.lit(_limit_text(rule.limit)))
    ratios = {
        "not_null_ratio": (DETAIL_NOT_NULL_RATIO, m >= rule.limit),
        "unique_ratio": (DETAIL_UNIQUE_RATIO, m >= rule.limit),
        "max_ratio_true": (DETAIL_TRUE_RATIO, m <= rule.limit),
    }
    if rule.check not in ratios:
        return F.lit(True), F.lit(DETAIL_UNKNOWN_CHECK)
    text, holds = ratios[rule.check]
    return holds, F.format_string(text, percent_text(m), F.lit(f"{rule.limit:.2%}"))


def validation_report(
    df: DataFrame, domain: str = "saas", rules: list[Rule] | None = None,
    sketch_distinct: bool = False,
) -> DataFrame:
    """One row per rule: its outcome (passed, warning or failure) and detail.

    A rule on a column the table lacks is a warning. Warnings count as passed.
    `sketch_distinct` estimates distinct counts within about one percent and
    spares the shuffle of the distinct values.
    """
    rules = rules_for(domain) if rules is None else rules
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "rule string, column string, outcome string, passed boolean, "
                "measure double, detail string")
    present = [r for r in rules if r.column in df.columns]
    aggregates = [_measure(r, df.schema[r.column].dataType, sketch_distinct).alias(r.name) for r in present]
    found = df.agg(*(aggregates or [F.count(F.lit(1)).alias("rows")]))
    rows = []
    for r in rules:
        if r in present:
            holds, detail = _verdict(r, F.col(r.name))
            ok = F.coalesce(holds, F.lit(False))
            worst = "failure" if r.severity == "error" else "warning"
            outcome = F.when(ok, F.lit("passed")).otherwise(F.lit(worst))
            measure = F.col(r.name)
        else:
            outcome, measure = F.lit("warning"), F.lit(None).cast("double")
            detail = F.lit(DETAIL_NO_COLUMN % r.column)
        rows.append({
            "rule": F.lit(r.name), "column": F.lit(r.column), "outcome": outcome,
            "passed": outcome != "failure", "measure": measure, "detail": detail,
        })
    return stack_rows(found, rows)


def validation_summary(report: DataFrame) -> DataFrame:
    """One row: overall verdict and counts. No rules at all is a pass."""
    counts = report.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("passed")).alias("passed_checks"),
        F.count_if(F.col("outcome") == "failure").alias("failed_checks"),
        F.count_if(F.col("outcome") == "warning").alias("warnings"),
    )
    return counts.select(
        (F.col("failed_checks") == 0).alias("passed"),
        "total_checks", "passed_checks", "failed_checks", "warnings",
        (F.col("passed_checks").cast("double")
         / F.greatest(F.col("total_checks"), F.lit(1)).cast("double")).alias("pass_rate"),
    )


def check_referential(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent, per missing key.

    The child is first reduced to its distinct keys with their counts, so a key
    held by a large share of the rows reaches the join as one row.
    """
    keys = child.filter(ref(key).isNotNull()).groupBy(ref(key).alias("key")).agg(
        F.count(F.lit(1)).alias("orphan_rows"))
    known = parent.select(ref(parent_key).alias("key"))
    return keys.join(known, "key", "left_anti")


def referential_summary(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    orphans = check_referential(child, key, parent, parent_key)
    return orphans.agg(
        F.count(F.lit(1)).alias("missing_keys"),
        F.coalesce(F.sum("orphan_rows"), F.lit(0)).alias("orphan_rows"),
    ).withColumn("passed", F.col("missing_keys") == 0)


def check_required(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Null counts of the columns a table must fill; an absent column is all null."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"n{i}")
          for i, c in enumerate(required) if c in df.columns],
    )
    return stack_rows(counts, [
        {
            "column": F.lit(c),
            "nulls": F.col(f"n{i}") if c in df.columns else F.col("rows"),
            "passed": (F.col(f"n{i}") if c in df.columns else F.col("rows")) == 0,
        }
        for i, c in enumerate(required)
    ])


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once in a column meant to be unique."""
    return (
        df.filter(ref(column).isNotNull()).groupBy(ref(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )
