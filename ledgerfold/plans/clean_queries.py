"""Cleaning steps over the dirty line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import (
    cap_outliers_iqr, cast_bools, cast_dates, cast_numerics, classify_columns, clean, dedup_rows,
    drop_high_null, fill_numeric_median, fill_text_unknown, infer_numeric_text, keep_null_dates,
)
from ..operators.profile import profile
from .fixtures import MESSY_SQL, messy, table
from .registry import query

_COLUMNS = ("line_ref", "customer_id", "mrr", "seats", "churned", "start_date", "churn_date",
            "usage_score", "part_code", "country", "note")
COUNT_NULLS = " union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as nulls from m""" for c in _COLUMNS)
_KEPT = ", ".join(c for c in _COLUMNS if c not in ("churn_date", "note"))
_MESSY = f"with m as ({MESSY_SQL})"


@query("drop_high_null", f"{_MESSY} select {_KEPT} from m")
def drop(spark, sf_dir):
    return drop_high_null(messy(spark, sf_dir))


@query("drop_high_null_protect", f"{_MESSY} select {_KEPT}, churn_date from m")
def drop_protect(spark, sf_dir):
    return drop_high_null(messy(spark, sf_dir), protect=("churn_date",))


@query("dedup_rows", f"{_MESSY} select distinct * from m")
def dedup(spark, sf_dir):
    return dedup_rows(messy(spark, sf_dir))


@query("cast_dates", f"""{_MESSY} select line_ref, try_cast(start_date as timestamp) as start_date,
  try_cast(churn_date as timestamp) as churn_date from m""")
def dates(spark, sf_dir):
    return cast_dates(messy(spark, sf_dir).select("line_ref", "start_date", "churn_date"))


@query("cast_bools", f"""{_MESSY} select line_ref,
  coalesce(churned in ('true', 'yes', '1'), false) as churned from m""")
def bools(spark, sf_dir):
    return cast_bools(messy(spark, sf_dir).select("line_ref", "churned"))


@query("cast_numerics", f"""{_MESSY} select line_ref, try_cast(mrr as double) as mrr,
  cast(seats as double) as seats from m""")
def numerics(spark, sf_dir):
    return cast_numerics(messy(spark, sf_dir).select("line_ref", "mrr", "seats"))


@query("infer_numeric_text", f"""{_MESSY} select line_ref, try_cast(usage_score as double) as
  usage_score, part_code from m""")
def infer(spark, sf_dir):
    return infer_numeric_text(messy(spark, sf_dir).select("line_ref", "usage_score", "part_code"))


_NUMBERS = f"""{_MESSY}, n as (select line_ref, try_cast(mrr as double) as mrr, seats,
  country, try_cast(start_date as timestamp) as start_date from m)"""
_FILLED = """round(coalesce(mrr, (select quantile_cont(mrr, 0.5) from n)), 6) as mrr,
  coalesce(seats, (select quantile_cont(seats, 0.5) from n)) as seats"""


def _numbers(spark, sf_dir):
    rows = messy(spark, sf_dir).select("line_ref", "mrr", "seats", "country", "start_date")
    return cast_dates(cast_numerics(rows))


@query("fill_numeric_median", f"{_NUMBERS} select line_ref, {_FILLED}, country, start_date from n")
def fill_median(spark, sf_dir):
    return fill_numeric_median(_numbers(spark, sf_dir)).withColumn("mrr", F.round("mrr", 6))


@query("fill_text_unknown", f"{_MESSY} select line_ref, coalesce(country, 'unknown') as country from m")
def fill_text(spark, sf_dir):
    return fill_text_unknown(messy(spark, sf_dir).select("line_ref", "country"))


@query("keep_null_dates", f"""{_NUMBERS} select line_ref, {_FILLED},
  coalesce(country, 'unknown') as country, start_date from n""")
def null_dates(spark, sf_dir):
    return keep_null_dates(_numbers(spark, sf_dir)).withColumn("mrr", F.round("mrr", 6))


def _fence(column: str, source: str, multiplier: str = "3") -> str:
    q1, q3 = (f"quantile_cont({column}, {q})" for q in ("0.25", "0.75"))
    return (f"(select {q1} - {multiplier} * ({q3} - {q1}) as lo, "
            f"{q3} + {multiplier} * ({q3} - {q1}) as hi from {source})")


@query("cap_outliers_iqr", f"""select event_id, round(case when value is not null
  then greatest(least(value, hi), lo) end, 6) as value from events, {_fence('value', 'events')}""")
def cap(spark, sf_dir):
    values = table(spark, sf_dir, "events").select("event_id", "value")
    return cap_outliers_iqr(values.withColumnRenamed("event_id", "id")).select(
        F.col("id").alias("event_id"), F.round("value", 6).alias("value"))


_CLEAN = f"""{_MESSY}, rows as (select distinct {_KEPT}, churn_date from m),
  typed as (select line_ref, customer_id, try_cast(mrr as double) as mrr, seats,
    coalesce(churned in ('true', 'yes', '1'), false) as churned,
    try_cast(start_date as timestamp) as start_date, try_cast(churn_date as timestamp) as churn_date,
    try_cast(usage_score as double) as usage_score, part_code,
    coalesce(country, 'unknown') as country from rows),
  filled as (select * replace (
    coalesce(mrr, (select quantile_cont(mrr, 0.5) from typed)) as mrr,
    coalesce(seats, (select quantile_cont(seats, 0.5) from typed)) as seats,
    coalesce(usage_score, (select quantile_cont(usage_score, 0.5) from typed)) as usage_score)
    from typed),
  fences as (select a.lo as mrr_lo, a.hi as mrr_hi, b.lo as seats_lo, b.hi as seats_hi,
      c.lo as usage_lo, c.hi as usage_hi
    from {_fence('mrr', 'filled')} a, {_fence('seats', 'filled')} b, {_fence('usage_score', 'filled')} c)"""


@query("clean", f"""{_CLEAN} select line_ref, customer_id, churned, start_date, churn_date, part_code,
  country, round(greatest(least(mrr, mrr_hi), mrr_lo), 6) as mrr,
  round(greatest(least(seats, seats_hi), seats_lo), 6) as seats,
  round(greatest(least(usage_score, usage_hi), usage_lo), 6) as usage_score from filled, fences""")
def cleaned(spark, sf_dir):
    result = clean(messy(spark, sf_dir), protect=("churn_date",))
    return result.frame.withColumns(
        {c: F.round(c, 6) for c in ("mrr", "seats", "usage_score")})


@query("clean_report", f"""{_CLEAN}, found as (
    select 'mrr' as "column", false as dropped, 'float' as conversion,
      (select count(*) - count(mrr) from typed) as nulls_filled,
      count(case when mrr < mrr_lo or mrr > mrr_hi then 1 end) as outliers_capped from filled, fences
    union all select 'seats', false, 'float', (select count(*) - count(seats) from typed),
      count(case when seats < seats_lo or seats > seats_hi then 1 end) from filled, fences
    union all select 'usage_score', false, 'float_inferred',
      (select count(*) - count(usage_score) from typed),
      count(case when usage_score < usage_lo or usage_score > usage_hi then 1 end)
      from filled, fences
    union all select 'churned', false, 'bool', 0, 0
    union all select 'start_date', false, 'datetime', 0, 0
    union all select 'churn_date', false, 'datetime', 0, 0
    union all select 'country', false, null, (select count(*) - count(country) from rows), 0
    union all select 'note', true, null, 0, 0)
  select *, (select count(*) from m) as original_rows, (select count(*) from rows) as final_rows,
    (select count(*) from m) - (select count(*) from rows) as duplicates_removed from found""")
def report(spark, sf_dir):
    result = clean(messy(spark, sf_dir), protect=("churn_date",))
    totals = result.report()
    return result.report_frame().select(
        "*", F.lit(totals.original_rows).cast("bigint").alias("original_rows"),
        F.lit(totals.final_rows).cast("bigint").alias("final_rows"),
        F.lit(totals.duplicates_removed).cast("bigint").alias("duplicates_removed"))


@query("classify_columns", f"""{_MESSY} select v.*, n.nulls from (values
  ('line_ref', 'other'), ('customer_id', 'other'), ('mrr', 'numeric'), ('seats', 'numeric'),
  ('churned', 'bool'), ('start_date', 'date'), ('churn_date', 'date'), ('usage_score', 'other'),
  ('part_code', 'other'), ('country', 'other'), ('note', 'other')) v("column", class)
  join ({COUNT_NULLS}) n on n."column" = v."column" """)
def classes(spark, sf_dir):
    """The class of each column, beside its null count."""
    rows = messy(spark, sf_dir)
    kinds = F.create_map(*[F.lit(x) for pair in classify_columns(rows.columns).items() for x in pair])
    return profile(rows).select("column", kinds[F.col("column")].alias("class"), "nulls")
