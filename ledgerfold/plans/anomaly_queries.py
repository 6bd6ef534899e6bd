"""Anomaly detection over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import stage
from ..operators.outliers import (
    anomalies, anomaly_columns, anomaly_prompt, baselines, iqr_anomalies, zscore_anomalies,
)
from ..operators.statistics import RANK_ERROR, column_statistics, merged_statistics, rank_errors, union_parts
from .fixtures import anomalies_sql, table
from .registry import query

_EVENTS = anomalies_sql("events", "event_id", ("value",), ", event_type")
# Supplier balances and part prices vary little; line items give several columns.
_LINES = "(select *, l_extendedprice * l_quantity * l_quantity as volume from lineitem)"


@query("anomaly_columns", """select "column", (select count(*) from lineitem) as rows,
  round(case "column" when 'l_quantity' then (select avg(l_quantity) from lineitem)
    when 'l_extendedprice' then (select avg(l_extendedprice) from lineitem)
    when 'l_discount' then (select avg(l_discount) from lineitem)
    when 'l_tax' then (select avg(l_tax) from lineitem)
    when 'l_orderkey' then (select avg(l_orderkey) from lineitem)
    when 'l_partkey' then (select avg(l_partkey) from lineitem)
    when 'l_suppkey' then (select avg(l_suppkey) from lineitem)
    else (select avg(l_linenumber) from lineitem) end, 4) as mean
  from (values ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_quantity'),
    ('l_extendedprice'), ('l_discount'), ('l_tax')) v("column")""")
def columns(spark, sf_dir):
    """The columns tested, with the mean each is held against."""
    lines = table(spark, sf_dir, "lineitem").withColumn("row_id", F.lit(1)).withColumn(
        "index_no", F.lit(1))
    usual = baselines(lines, anomaly_columns(lines))
    return lines.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.round(F.lit(b.mean), 4).alias("mean"))
        for c, b in usual.items()
    ])))


@query("zscore_anomalies", """select event_id, value, round(z, 4) as score from (
  select *, abs((value - m) / sd) as z from events,
    (select avg(value) as m, stddev_samp(value) as sd from events)) where z > 2.5""")
def by_z(spark, sf_dir):
    found = zscore_anomalies(table(spark, sf_dir, "events"), "value", keep=("event_id",))
    return found.withColumn("score", F.round("score", 4))


@query("iqr_anomalies", """select event_id, value from events, (
    select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
  where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def by_range(spark, sf_dir):
    return iqr_anomalies(table(spark, sf_dir, "events"), "value", keep=("event_id",))


def _found(spark, sf_dir):
    return anomalies(table(spark, sf_dir, "events"), keep=("event_id",), columns=["value"],
                     context=["event_id", "user_id", "event_type", "value"])


@query("anomalies", f"""select row_key as event_id, column_name, method, value,
  round(score, 4) as score, severity from ({_EVENTS})""")
def cells(spark, sf_dir):
    return _found(spark, sf_dir).select(
        "event_id", "column_name", "method", "value", F.round("score", 4).alias("score"), "severity")


_VOLUME_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "volume")
_VOLUME_KEY = "concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber)"


@query("anomalies_many_columns", f"""with src as {_LINES}
  select row_key, column_name, method, round(value, 4) as value, round(score, 4) as score, severity
  from ({anomalies_sql('src', _VOLUME_KEY, _VOLUME_COLUMNS)})""")
def many(spark, sf_dir):
    """Several columns of the line items in one scan."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "volume", F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity"))
    keyed = lines.withColumn("row_key", F.concat_ws(
        "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
    found = anomalies(keyed, keep=("row_key",), columns=list(_VOLUME_COLUMNS), context=["volume"])
    return found.select("row_key", "column_name", "method", F.round("value", 4).alias("value"),
                        F.round("score", 4).alias("score"), "severity")


@query("anomaly_severity", f"""select severity, method, count(*) as cells from ({_EVENTS})
  group by severity, method""")
def severity(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("severity", "method").agg(
        F.count(F.lit(1)).alias("cells"))


@query("anomaly_context", f"""select event_id, concat('{{"event_id":', event_id, ',"user_id":', user_id,
  ',"event_type":"', event_type, '","value":', value, '}}') as row_context
  from events where event_id in (select row_key from ({_EVENTS}))""")
def context(spark, sf_dir):
    return _found(spark, sf_dir).select("event_id", "row_context")


@query("expected_range", f"select row_key as event_id, expected_range from ({_EVENTS})")
def expected(spark, sf_dir):
    return _found(spark, sf_dir).select("event_id", "expected_range")


@query("anomaly_prompt", f"""select row_key as event_id, concat(
  'Explain the following data anomaly to a subscription business.', chr(10),
  'Dataset events, column ', column_name, ': value ', value, ', usual range ', expected_range,
  ', found by ', method, ' with score ', printf('%.2f', score), '.', chr(10), 'Row: ',
  '{{"event_id":', row_key, ',"column_name":"', column_name, '"}}', chr(10),
  'Answer in two or three sentences: likely cause and what to check.') as prompt
  from ({_EVENTS})""")
def prompt(spark, sf_dir):
    found = _found(spark, sf_dir)
    return found.select(
        "event_id", anomaly_prompt(found, "events", ["event_id", "column_name"]).alias("prompt"))


_PARTED = ("l_quantity", "l_extendedprice", "l_discount")


@query("merged_statistics", " union all ".join(f"""select '{c}' as column_name, count(*) as rows, count({c}) as n,
  min({c})::double as minimum, max({c})::double as maximum, round(avg({c}::double), 4) as mean,
  round(stddev_samp({c}::double), 4) as deviation, true as within from lineitem""" for c in _PARTED))
def merged_parts(spark, sf_dir):
    """Statistics of four parts, merged; the quartiles' ranks are within the stated error of the exact ones."""
    lines = table(spark, sf_dir, "lineitem").select(*_PARTED, "l_orderkey")
    parts = stage(union_parts([
        column_statistics(lines.filter(F.col("l_orderkey") % 4 == i), list(_PARTED)) for i in range(4)]), "statistics")
    whole = stage(merged_statistics(parts), "statistics")
    within = rank_errors(lines, whole).groupBy("column_name").agg((F.max("rank_error") <= RANK_ERROR).alias("within"))
    return whole.join(within, "column_name").select(
        "column_name", "rows", "n", "minimum", "maximum", F.round("mean", 4).alias("mean"),
        F.round(F.sqrt(F.col("m2") / (F.col("n") - 1)), 4).alias("deviation"), "within")
