"""Schema detection and profiling of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_path
from ..operators.profile import (
    apply_mapping, canonical_mapping, detect_domain, domain_score, high_null_warnings,
    id_like_columns, infer_text_types, nullable_columns, profile, profile_files, sample_rows,
)
from .clean_queries import COUNT_NULLS
from .fixtures import MESSY_SQL, SUBSCRIPTIONS, messy, subscriptions, table
from .registry import query


@query("profile_dtypes", """select column_name as "column",
  case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
    when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' else data_type end as dtype,
  (select count(*) from lineitem) as rows
  from information_schema.columns where table_name = 'lineitem'""")
def dtypes(spark, sf_dir):
    return profile(table(spark, sf_dir, "lineitem")).select("column", "dtype", "rows")


@query("profile_nullable", f"""with m as ({MESSY_SQL}) select * from ({COUNT_NULLS}) where nulls > 0""")
def nullable(spark, sf_dir):
    return nullable_columns(messy(spark, sf_dir))


@query("detect_domain", f"""select 'saas' as domain, 10 as score, count(*) as rows
  from ({SUBSCRIPTIONS})""")
def domain(spark, sf_dir):
    subs = subscriptions(spark, sf_dir)
    return subs.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(detect_domain(subs.columns)).alias("domain"),
        F.lit(domain_score(subs.columns)).alias("score"), "rows")


_HEADERS = "o_custkey as client_id, o_totalprice as revenue, o_orderpriority as tier, " \
           "o_orderstatus as account_status, o_orderkey as other"


@query("canonical_mapping", """select canonical, found, (select count(*) from orders) as rows
  from (values ('customer_id', 'client_id'), ('mrr', 'revenue'), ('plan', 'tier'),
               ('status', 'account_status')) v(canonical, found)""")
def mapping(spark, sf_dir):
    orders = spark.sql("select " + _HEADERS + " from {orders}",
                       orders=table(spark, sf_dir, "orders"))
    found = canonical_mapping(orders.columns)
    return orders.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("canonical"), F.lit(f).alias("found")) for f, c in found.items()
    ])))


@query("apply_mapping", """select o_custkey as customer_id, o_totalprice as mrr,
  o_orderpriority as plan, o_orderstatus as status, o_orderkey as other from orders""")
def rename(spark, sf_dir):
    orders = spark.sql("select " + _HEADERS + " from {orders}",
                       orders=table(spark, sf_dir, "orders"))
    return apply_mapping(orders, canonical_mapping(orders.columns))


@query("warn_high_null", f"""with m as ({MESSY_SQL}) select "column", concat('Column ''', "column",
  ''' has ', format('{{:.0f}}', nulls * 100.0 / rows), '% nulls — consider dropping') as warning
  from (select *, (select count(*) from m) as rows from ({COUNT_NULLS}))
  where cast(nulls as double) / rows > 0.5""")
def high_null(spark, sf_dir):
    return high_null_warnings(messy(spark, sf_dir))


@query("warn_id_like", """select 'c_name' as "column",
  'Column ''c_name'' may be an ID column (all unique)' as warning
  from customer having count(distinct c_name) = count(*)""")
def id_like(spark, sf_dir):
    return id_like_columns(table(spark, sf_dir, "customer"))


@query("sample_rows", """select o_orderkey, o_custkey, o_totalprice from orders
  order by o_totalprice desc, o_orderkey limit 3""")
def sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sample_rows(orders, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("infer_text_types", """select l_orderkey as k, l_quantity as q, l_linenumber % 2 = 0 as even,
  l_returnflag as flag from lineitem""")
def inferred(spark, sf_dir):
    """All-text columns take the type every value has."""
    texts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("k"), F.col("l_quantity").cast("string").alias("q"),
        F.initcap((F.col("l_linenumber") % 2 == 0).cast("string")).alias("even"),
        F.col("l_returnflag").alias("flag"))
    return infer_text_types(texts)


_STORED = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_discount": "double", "l_returnflag": "string"}


@query("profile_files", " union all ".join(f"""select '{c}' as "column", '{t}' as dtype, count(*) as rows,
  count(*) - count({c}) as nulls, {f'min({c})::double' if t != 'string' else 'null::double'} as minimum,
  {f'max({c})::double' if t != 'string' else 'null::double'} as maximum
  from (select case when l_orderkey % 9 = 0 then null else {c} end as {c} from lineitem)""" for c, t in _STORED.items()))
def stored_profile(spark, sf_dir):
    """The profile of stored files from their footers, and a scan of the floating columns; NaN stands for null there."""
    path = new_path(spark, "profiled")
    lines = table(spark, sf_dir, "lineitem")
    none = lambda t: F.lit(float("nan") if t == "double" else None)
    lines.select(*[F.when(F.col("l_orderkey") % 9 == 0, none(t)).otherwise(F.col(c)).cast(t).alias(c) for c, t in _STORED.items()]) \
        .repartition(3).write.parquet(path)
    found = profile_files(spark, path)
    return found.select("column", "dtype", "rows", "nulls", F.col("minimum").try_cast("double").alias("minimum"),
                        F.col("maximum").try_cast("double").alias("maximum"))
