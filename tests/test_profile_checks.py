import pytest

from ledgerfold.operators.checks import (
    check_referential, check_required, referential_summary, repeated_values, validation_report,
    validation_summary,
)
from ledgerfold.operators.profile import (
    apply_mapping, canonical_mapping, detect_domain, detect_schema, infer_text_types,
)

RULE_COLUMNS = "customer_id string, mrr double, churned boolean"


def _outcomes(df, domain="saas"):
    return {r["rule"]: r for r in validation_report(df, domain).collect()}


def test_domain_and_mapping(spark):
    df = spark.createDataFrame([("c1", 100, "starter", False, "active", "2023-01-01")],
                               "customer_id string, mrr int, plan string, churned boolean, "
                               "status string, start_date string")
    schema = detect_schema(df)
    assert schema.detected_domain == "saas" and len(schema.column_mapping) == 6
    assert schema.dtypes["mrr"] == "int"
    assert detect_domain(["col_a", "col_b"]) == "generic"


def test_mapping_renames_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(100, "c1", 1)], "monthly_revenue int, client_id string, other int")
    assert apply_mapping(df, canonical_mapping(df.columns)).columns == ["mrr", "customer_id", "other"]


def test_exact_header_wins_over_an_earlier_hint():
    assert canonical_mapping(["revenue", "mrr"]) == {"mrr": "mrr"}
    assert canonical_mapping(["revenue", "monthly_revenue"]) == {"revenue": "mrr"}


def test_nullable_warnings_and_sample(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, float("nan")), ("c", "x", 2.0)],
                               "k string, rare string, v double")
    schema = detect_schema(df)
    assert {r["column"]: r["nulls"] for r in schema.nullable_columns.collect()} == {"rare": 2, "v": 1}
    texts = {r["column"]: r["warning"] for r in schema.warnings.collect()}
    assert texts == {"rare": "Column 'rare' has 67% nulls — consider dropping",
                     "k": "Column 'k' may be an ID column (all unique)"}
    assert schema.sample_rows.count() == 3


def test_text_types_need_every_value(spark):
    df = spark.createDataFrame(
        [("1", "True", "1.5", "1", None), ("2", "FALSE", "x", None, None)],
        "i string, b string, t string, n string, e string")
    assert infer_text_types(df).dtypes == [
        ("i", "bigint"), ("b", "boolean"), ("t", "string"), ("n", "bigint"), ("e", "string")]


def test_clean_data_passes(spark):
    df = spark.createDataFrame(
        [("c1", 100.0, False), ("c2", 200.0, False), ("c3", 300.0, True)], RULE_COLUMNS)
    row = validation_summary(validation_report(df)).first()
    assert row["passed"] and row["failed_checks"] == 0 and row["pass_rate"] == 1.0


def test_negative_revenue_fails(spark):
    df = spark.createDataFrame([("c1", -100.0, False), ("c2", 200.0, False)], RULE_COLUMNS)
    found = _outcomes(df)
    assert found["mrr_not_negative"]["outcome"] == "failure"
    assert found["mrr_not_negative"]["detail"] == "1 values below 0"
    assert not validation_summary(validation_report(df)).first()["passed"]


def test_high_churn_warns_and_still_passes(spark):
    df = spark.createDataFrame([(f"c{i}", 100.0, i < 99) for i in range(100)], RULE_COLUMNS)
    found = _outcomes(df)
    assert found["churn_rate_valid"]["outcome"] == "warning"
    assert found["churn_rate_valid"]["detail"] == "true ratio = 99.00%, max allowed = 95.00%"
    assert validation_summary(validation_report(df)).first()["passed"]


def test_missing_columns_are_skipped(spark):
    found = _outcomes(spark.createDataFrame([(1,), (2,)], "some_col int"))
    assert len(found) == 5 and {r["outcome"] for r in found.values()} == {"warning"}
    assert found["mrr_not_negative"]["detail"] == "Column 'mrr' not present — skipped"


def test_empty_table_fails_the_ratios(spark):
    found = _outcomes(spark.createDataFrame([], RULE_COLUMNS))
    assert {k: r["outcome"] for k, r in found.items()} == {
        "mrr_not_negative": "passed", "mrr_not_extreme": "passed", "churn_rate_valid": "warning",
        "customer_id_not_null": "failure", "customer_id_unique": "warning"}
    assert "nan%" in found["customer_id_not_null"]["detail"]


def test_other_domains_have_no_rules(spark):
    row = validation_summary(validation_report(spark.range(3).toDF("mrr"), "generic")).first()
    assert row["passed"] and row["total_checks"] == 0


def test_references(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (9,), (None,)], "ref int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert check_referential(child, "ref", parent, "id").collect() == [(9, 3)]
    row = referential_summary(child, "ref", parent, "id").first()
    assert (row["missing_keys"], row["orphan_rows"], row["passed"]) == (1, 3, False)


def test_required_and_unique(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "name string, k int")
    rows = {r["column"]: (r["nulls"], r["passed"])
            for r in check_required(df, ("name", "k", "absent")).collect()}
    assert rows == {"name": (1, False), "k": (0, True), "absent": (3, False)}
    assert repeated_values(df, "name").collect() == [("a", 2)]


def test_rules_are_answered_by_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("c1", 1.0, True)], RULE_COLUMNS).write.parquet(path)
    plan = validation_report(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("values,warned", [(["a", "b", "c"], True), (["a", "b", "b"], False),
                                           (["a", "b", None], False)])
def test_id_like(spark, values, warned):
    df = spark.createDataFrame([(v,) for v in values], "k string")
    rows = [r for r in detect_schema(df).warnings.collect() if "all unique" in r["warning"]]
    assert bool(rows) == warned
