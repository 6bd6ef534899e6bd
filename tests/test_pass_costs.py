"""Passes over a whole table do per row what the row needs, with the same results."""

from pyspark.sql import functions as F

from ledgerfold.functions import ranks
from ledgerfold.operators.enrich import INDUSTRY_WORDS, PLAN_WORDS, by_words, enrich
from ledgerfold.operators.profile import infer_text_types


def test_ranks_at_the_ends_of_their_interval_need_no_rows(spark, monkeypatch):
    values = spark.range(1000).select(F.when(F.col("id") % 10 < 7, 1.0).otherwise(4.0).alias("c"))
    grid = values.agg(ranks.sketch(F.col("c"))).first()[0]
    monkeypatch.setattr(ranks.F, "inline", None)
    found = ranks.order_statistics(values, {"c": [0, 250, 699, 700, 999]}, {"c": 1000}, {"c": grid})
    assert [found["c", r] for r in (0, 250, 699, 700, 999)] == [1.0, 1.0, 1.0, 4.0, 4.0]


def test_labels_need_no_pattern_per_label(spark):
    rows = spark.createDataFrame(
        [(p, n, 700.0) for p, n in (
            ("ENTERPRISE", "Data Bank"), ("the Team", "banK"), ("Busİness", "İ STEEL mill"), ("café PLUS", "ſchool"),
            ("x", ""), (None, None), ("Premium team", "News\nCollege"))], "plan string, customer_name string, mrr double")
    labelled = enrich(rows)
    assert "(?i)" not in labelled._jdf.queryExecution().executedPlan().toString() and labelled.columns[:3] == rows.columns and len(labelled.columns) == 6
    by_pattern = rows.select(
        "plan", F.when(F.col("plan").isNotNull(), by_words(F.col("plan"), PLAN_WORDS, "professional")).alias("plan_category"),
        F.when(F.col("customer_name").isNotNull(), by_words(F.col("customer_name"), INDUSTRY_WORDS, "other")).alias("industry_category"))
    assert labelled.select(*by_pattern.columns).collect() == by_pattern.collect()


def test_types_of_texts(spark):
    rows = [(" 12 ", "1e3", "True", "12345678901234567890", "1", "9" * 39, "inf", "x"),
            ("+5", "-.5", "false", "3", "true", "1", "Infinity", "2"), (None,) * 8]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(8)))
    assert [t for _, t in infer_text_types(df).dtypes] == [
        "bigint", "double", "boolean", "decimal(38,0)", "string", "string", "double", "string"]
