"""The stages together, and what a caller asks of the service."""

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import serving
from ledgerfold.plans.etl import run_etl
from ledgerfold.plans.service import (
    anomalies_of, answer, dashboard, etl_histogram, generate_report, ingest, metrics_of, register_upload,
)
from ledgerfold.sources import Store


def _export(path, n=120):
    lines = ["Client ID,Monthly Revenue,Tier,Status,churned,Start Date,churn_date,churn_reason,seats"]
    for i in range(n):
        gone = i % 4 == 0
        revenue = 90000 if i == 7 else 100 + i % 9
        lines.append(",".join([
            f"c{i}", str(revenue), "basic" if i % 2 else "enterprise", "churned" if gone else "active",
            str(gone), f"2023-{1 + i % 5:02d}-03", f"2023-{3 + i % 5:02d}-20" if gone else "",
            "Too expensive" if gone else "", "" if i % 10 == 0 else str(1 + i % 6)]))
    path.write_text("\n".join([*lines, lines[-1]]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    store = Store(spark, str(folder / "store"))
    run = ingest(store, _export(folder / "export.csv"), "spring", key=("customer_id",))
    return store, run


def test_run_result(done):
    store, run = done
    assert (run.rows_processed, run.rows_final, run.status) == (121, 120, "completed")
    assert run.validation_passed and run.cleaning.duplicates_removed == 1
    assert run.cleaning.columns_dropped == [] and run.cleaning.nulls_filled["seats"] == 12
    state = store.datasets().first()
    assert (state["name"], state["status"], state["row_count"], state["column_count"]) == ("spring", "ready", 121, 9)
    assert json.loads(state["validation_report"])["passed"] is True
    job = store.jobs().first()
    assert (job["status"], job["progress"], job["stage"], job["rows_cleaned"]) == ("completed", 100, "done", 120)
    assert store.job(job["id"]).count() == 1


def test_stored_rows(done):
    store, run = done
    rows = {r["customer_id"]: r for r in store.table("subscriptions").collect()}
    assert len(rows) == 120 and rows["c7"]["mrr"] < 1000
    assert rows["c0"]["churned"] and rows["c0"]["churn_reason_category"] == "price"
    assert rows["c1"]["churn_reason"] == "unknown" and rows["c1"]["churn_reason_category"] is None
    assert rows["c2"]["plan_category"] == "enterprise" and rows["c0"]["lifetime_months"] > 0
    metrics = store.table("metrics").orderBy("period").collect()
    assert [m["period"] for m in metrics] == [f"2023-{m:02d}" for m in range(1, 6)]
    assert sum(m["new_customers"] for m in metrics) == 120


def test_name_is_taken_once_ready(done, tmp_path):
    store, _ = done
    with pytest.raises(ValueError, match="already named"):
        register_upload(store, _export(tmp_path / "b.csv", 5), "spring")
    with pytest.raises(ValueError, match="the limit is"):
        register_upload(store, _export(tmp_path / "c.csv", 5), "other", max_bytes=10)
    with pytest.raises(ValueError, match="cannot read"):
        register_upload(store, str(tmp_path / "c.xlsx"), "other")


def test_answers_are_logged(done):
    store, run = done
    sql = (f"```sql\nSELECT plan, AVG(churned::int) as churn_rate FROM saas_subscriptions WHERE dataset_id = "
           f"'{run.dataset_id}' GROUP BY plan ORDER BY churn_rate DESC LIMIT 1\n```")
    assert [r["plan"] for r in answer(store, "Which plan has the highest churn rate?", sql)] == ["enterprise"]
    assert len(answer(store, "all", "select * from saas_subscriptions")) == 100
    assert answer(store, "bad", "drop table saas_subscriptions") == []
    log = {r["question"]: r for r in store.table("query_log").collect()}
    assert log["all"]["result_rows"] == 100 and log["all"]["success"]
    assert not log["bad"]["success"] and "read-only" in log["bad"]["error_message"]


def test_report(done):
    store, run = done
    text = generate_report(store, run.dataset_id, "2024-02").first()["markdown"]
    assert text.startswith("# Subscription report 2024-02")
    assert "period | MRR | churn_rate | active_customers\n2023-01 | $" in text
    assert "reason: price" in text
    log = store.table("reports").first()
    assert log["period"] == "2024-02" and log["markdown_content"] == text
    assert store.report(log["id"]).count() == 1
    with pytest.raises(ValueError, match="no metrics"):
        generate_report(store, "absent")


def test_rerun_replaces(done, spark, tmp_path):
    store, _ = done
    path = _export(tmp_path / "again.csv", 40)
    for _ in range(2):
        run_etl(spark, store, "second", "csv", path=path, key=("customer_id",))
    assert store.table("subscriptions").filter("dataset_id = 'second'").count() == 40
    store.delete_dataset("second")
    assert store.table("metrics").filter("dataset_id = 'second'").count() == 0
    assert "second" not in {r["id"] for r in store.datasets().collect()}


def test_staged_tables_go_with_the_run(done, spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    assert not list(folder.glob("**/run-*"))


def test_state_after_the_run(done):
    store, run = done
    state = store.datasets().first()
    assert json.loads(state["etl_config"])["hash"] and state["created_at"] <= state["updated_at"]
    assert json.loads(state["validation_report"])["pass_rate"] == 1.0
    stages = {r["stage"] for r in store.table("jobs").collect()}
    assert {"schema_detection", "transforming", "enrichment"} <= stages


def test_reads_over_the_store(done):
    store, run = done
    assert [r["period"] for r in metrics_of(store, run.dataset_id, last=2).collect()] == ["2023-04", "2023-05"]
    rows, total = anomalies_of(store, run.dataset_id, limit=1)
    assert rows.count() == 1 and total == run.anomalies_found > 1
    assert json.loads(rows.first()["row_key"])["customer_id"].startswith("c")
    board = dashboard(store).filter(F.col("dataset_id") == run.dataset_id).first()
    assert (board["dataset_name"], board["latest_period"]) == ("spring", "2023-05")
    assert etl_histogram(store).filter("le = '+Inf'").first()["observations"] >= 1


def test_empty_run_replaces_the_rows_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run_etl(spark, store, "d", "csv", path=_export(tmp_path / "a.csv", 30), key=("customer_id",))
    header = (tmp_path / "a.csv").read_text().splitlines()[0]
    (tmp_path / "b.csv").write_text(header + "\n")
    run_etl(spark, store, "d", "csv", path=str(tmp_path / "b.csv"), key=("customer_id",))
    assert store.table("subscriptions").count() == 0 and store.table("anomalies").count() == 0


def test_other_dates_models_and_explanations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    text = open(_export(tmp_path / "a.csv", 60)).read()
    path = tmp_path / "us.csv"
    path.write_text(re.sub(r"(\d{4})-(\d\d)-(\d\d)", r"\2/\3/\1", text).replace(",", ";"))
    run = ingest(
        store, str(path), "us", key=("customer_id",), sep=";",
        models={"industry_category": _model("retail", "industry_category"),
                "churn_reason_category": _model("support", "category")},
        explain=lambda: lambda prompts: ["as usual" for _ in prompts])
    rows = store.table("subscriptions").collect()
    assert {r["churn_reason_category"] for r in rows} == {None, "support"} and run.cleaning.dates_lost == {}
    assert store.table("metrics").count() == 5
    assert {r["llm_explanation"] for r in store.table("anomalies").collect()} == {"as usual"}


def _model(label, key):
    return lambda: lambda prompts: [json.dumps({key: label}) for _ in prompts]


@pytest.mark.parametrize("sql", [
    "select reflect('java.lang.System', 'getProperty', 'user.home')", "select `java_method`('java.lang.System', 'gc')",
    "select * from parquet.`/tmp`", "select * from other_table", "with a as (select * from csv.`/etc/passwd`) select * from a",
    "select (select max(x) from hidden) from saas_metrics",
])
def test_statements_stay_within_the_named_tables(spark, sql):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("hidden")
    tables = {"saas_metrics": spark.createDataFrame([(1, "reflect(x)")], "x int, t string")}
    with pytest.raises(ValueError):
        serving.safe_sql(spark, sql, tables).collect()
    kept = "with a as (select x from saas_metrics) select x, 'reflect(' as t from a where x in (select x from SAAS_METRICS)"
    assert serving.safe_sql(spark, kept, tables).collect() == [(1, "reflect(")]
    assert "saas_metrics" not in [t.name for t in spark.catalog.listTables()]


def test_failure_is_recorded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = tmp_path / "empty.csv"
    path.write_text("")
    with pytest.raises(ValueError):
        run_etl(spark, store, "bad", "csv", job_id="j", path=str(path))
    assert store.datasets().first()["status"] == "failed"
    job = store.job("j").first()
    assert (job["status"], job["stage"], job["progress"]) == ("failed", "fetching", 0)


def test_failed_validation_does_not_stop_the_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = tmp_path / "neg.csv"
    path.write_text("customer_id,mrr,plan,status\n" + "".join(f"c{i},{-i},p,active\n" for i in range(30)))
    run = run_etl(spark, store, "neg", "csv", path=str(path), key=("customer_id",))
    assert not run.validation_passed and store.table("subscriptions").count() == 30
    assert store.table("metrics").count() == 1


def test_generic_table_and_other_kinds(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([(i, f"t{i}") for i in range(20)], "col_a int, col_b string").write.parquet(
        str(tmp_path / "g"))
    run = run_etl(spark, store, "g", "parquet", path=str(tmp_path / "g"), detect=False)
    assert run.validation_passed and run.anomalies_found == 0 and run.rows_final == 20


@pytest.mark.parametrize("sql,safe,strict", [
    ("select 1", True, True), ("SELECT created_at from t", True, False), ("with a as (select 1) select * from a", True, False),
    ("update t set a = 1", False, False), ("select 1; drop table t", False, False), ("", False, False),
    ("selection", False, True),
])
def test_read_only_guard(sql, safe, strict):
    assert serving.is_safe_sql(sql) == safe
    assert serving.is_safe_sql(sql, strict=True) == strict


def test_code_fences():
    assert serving.clean_sql("```SQL\nselect 1\n```") == "select 1"


def test_empty_report_blocks(spark):
    metrics = spark.createDataFrame([("2024-01", 1.0, 1.0, 0.0, 1.0, 1, 0.0, None, None)],
                                    "period string, mrr double, new_mrr double, churned_mrr double, net_new_mrr double, "
                                    "active_customers bigint, churn_rate double, nrr double, arpu double")
    subs = spark.createDataFrame([], "k int, churned boolean, mrr double, plan string, customer_name string, "
                                     "customer_id string, churn_reason_category string")
    cells = spark.createDataFrame([], "k int, column_name string, severity string, value double, score double")
    row = serving.report_context(subs, metrics, cells, "k", "k", "p").first()
    assert row["churned_customers"] == "No churned customers found."
    assert row["anomalies"] == "No significant anomalies detected."
    assert json.loads(row["metrics"])["nrr"] == 0.0
