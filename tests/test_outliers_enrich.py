import json
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators.enrich import (
    enrich, enrich_with_model, enrichment_report, parse_reply, render_prompt,
)
from ledgerfold.operators.outliers import (
    anomalies, anomaly_columns, anomaly_prompt, explain_anomalies, iqr_anomalies, stored_context, zscore_anomalies,
)


@pytest.fixture(scope="module")
def spiky(spark):
    values = [100.0 + i % 7 for i in range(60)] + [250.0, 104.0, None, float("nan")]
    return spark.createDataFrame(
        [(f"k{i}", v, 5.0, float(i % 3) if i < 9 else None) for i, v in enumerate(values)],
        "ref string, mrr double, flat double, few double")


def test_detection_follows_the_definition(spiky):
    values = [r["mrr"] for r in spiky.collect() if r["mrr"] is not None and r["mrr"] == r["mrr"]]
    mean, std = statistics.mean(values), statistics.stdev(values)
    rows = anomalies(spiky, keep=("ref",)).collect()
    assert [(r["ref"], r["column_name"], r["method"], r["value"], r["severity"]) for r in rows] == [
        ("k60", "mrr", "zscore+iqr", 250.0, "high")]
    assert rows[0]["score"] == pytest.approx(abs(250.0 - mean) / std)
    assert json.loads(rows[0]["row_context"]) == {"mrr": 250.0, "flat": 5.0, "few": None}


def test_constant_and_short_columns_are_left_out(spiky):
    assert anomalies(spiky, keep=("ref",), columns=["flat", "few"]).count() == 0
    assert zscore_anomalies(spiky, "flat").count() == 0
    assert iqr_anomalies(spiky, "few").count() == 0


def test_methods_and_severities(spark):
    # 3.5 deviations, and beyond the fence but close to the mean.
    wide = [float(i % 2) for i in range(100)] + [2.2]
    rows = anomalies(spark.createDataFrame([(v,) for v in wide], "x double")).collect()
    assert [(r["method"], r["severity"]) for r in rows] == [("zscore", "medium")]
    narrow = [10.0] * 30 + [11.0] * 30 + [13.0]
    rows = anomalies(spark.createDataFrame([(v,) for v in narrow], "x double")).collect()
    assert [(r["method"], r["expected_range"]) for r in rows] == [("zscore+iqr", "8.50 – 12.50")]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, "a")], "paid int, growth int, Index_no int, mrr int, t string")
    assert anomaly_columns(df) == ["mrr"]
    assert anomaly_columns(df, skip=()) == ["paid", "growth", "Index_no", "mrr"]


def test_scan_gets_the_fences(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(float(i),) for i in range(50)], "x double").write.parquet(path)
    plan = iqr_anomalies(spark.read.parquet(path), "x")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(x" in plan


def test_context_is_whole_and_prompt_shows_it(spiky):
    found = anomalies(spiky, keep=("ref",))
    long = F.repeat(F.lit("x"), 5000)
    assert tuple(found.select(F.length(stored_context(long)), F.length(stored_context(long, 1000))).first()) == (5000, 1000)
    text = found.select(anomaly_prompt(found, "d", ["ref", "value"])).first()[0]
    assert "Dataset d, column mrr: value 250.0" in text and '{"ref":"k60","value":250.0}' in text


@pytest.fixture(scope="module")
def subs(spark):
    return spark.createDataFrame([
        (1, "Starter Kit", 50.0, "Acme Software", "active", "unknown", 3.0, "US", 2),
        (2, "Enterprise", 9000.0, "First Bank", "churned", "Too expensive", 30.0, "BR", 90),
        (3, None, 700.0, None, "trial", None, None, "DE", None),
        (4, "Gold", None, "Plain Co", "active", "no", None, None, 10),
        (5, "Gold", 700.0, "City Clinic", "active", "Switched to competitor", 8.0, "US", 10),
    ], "k int, plan string, mrr double, customer_name string, status string, churn_reason string, "
       "lifetime_months double, country string, seats int")


def test_labels_guards_and_fallbacks(subs):
    rows = [tuple(r) for r in enrich(subs).orderBy("k").select(
        "plan_category", "churn_reason_category", "churn_risk_score", "industry_category").collect()]
    assert rows == [
        ("starter", None, 0.5, "tech"),
        ("enterprise", "price", 0.7, "finance"),
        (None, None, 0.35, None),
        ("unknown", None, 0.5, "other"),
        ("professional", "competition", 0.2, "healthcare"),
    ]


def test_report_counts_labels_and_fallbacks(subs):
    rows = {r["field"]: (r["labelled"], r["fallbacks"]) for r in enrichment_report(enrich(subs)).collect()}
    assert rows == {"plan_category": (4, 1), "churn_reason_category": (2, 0),
                    "churn_risk_score": (5, 2), "industry_category": (4, 1)}


def test_head_only(subs):
    rows = enrich(subs, max_rows=2, order_by=("k",)).orderBy("k").collect()
    assert [r["industry_category"] for r in rows] == ["tech", "finance", None, None, None]


def test_head_of_repeated_keys(subs):
    """A key that repeats inside the head does no harm; at its end it is refused."""
    twice = subs.unionByName(subs.filter("k = 1"))
    rows = enrich(twice, max_rows=3, order_by=("k",)).collect()
    assert len(rows) == 6 and sum(r["churn_risk_score"] is not None for r in rows) == 3
    with pytest.raises(ValueError, match="repeats"):
        enrich(twice, max_rows=1, order_by=("k",))
    with pytest.raises(ValueError, match="unique key"):
        enrich(subs, max_rows=1)
    assert enrich(subs, max_rows=99, order_by=("k",)).filter("plan_category is not null").count() == 4
    by_country = enrich(subs, max_rows=2, order_by=("country", "k")).orderBy("k").collect()
    assert [r["churn_risk_score"] is not None for r in by_country] == [False, True, False, True, False]


def test_absent_columns_get_no_label(subs):
    assert "industry_category" not in enrich(subs.drop("customer_name")).columns


def test_prompts(subs):
    bare = subs.select("k", "plan", "mrr")
    texts = [r[0] for r in bare.orderBy("k").select(render_prompt(bare, "plan_category")).collect()]
    assert "Plan: Starter Kit\nMRR: 50.0\nSeats: unknown" in texts[0]
    assert texts[2] is None and "MRR: nan" in texts[3]
    odd = bare.withColumn("plan", F.lit("{mrr}"))
    assert "Plan: {mrr}\n" in odd.select(render_prompt(odd, "plan_category")).first()[0]


def test_replies(spark):
    df = spark.createDataFrame([(t,) for t in (
        '{"s": "0.25"}', '```json\n{"s": 0.5}\n```', '```{"s": 1}```', '{"s": "high"}', '{"t": 1}',
        "no idea", None)], "reply string")
    assert [r[0] for r in df.select(parse_reply(F.col("reply"), "s", 0.75)).collect()] == [
        0.25, 0.5, 1.0, 0.75, 0.75, 0.75, 0.75]


def _model(calls_path):
    def make():
        def classify(prompts):
            with open(calls_path, "a") as log:
                log.writelines("x\n" for _ in prompts)
            if any("boom" in p for p in prompts):
                raise RuntimeError("model is down")
            return ['{"category": "price"}' if "expensive" in p else "?" for p in prompts]
        return classify
    return make


def test_model_sees_each_prompt_once(spark, tmp_path):
    """Most rows share a reason, many have none."""
    reasons = ["too expensive"] * 300 + ["bad fit"] * 40 + ["slow help"] * 5 + [None] * 20 + ["unknown"]
    df = spark.createDataFrame(list(enumerate(reasons)), "k int, churn_reason string").repartition(4)
    calls = tmp_path / "calls"
    rows = enrich_with_model(df, "churn_reason_category", _model(str(calls))).collect()
    labels = {r["k"]: r["churn_reason_category"] for r in rows}
    want = {k: None if v in (None, "unknown") else "price" if v == "too expensive" else "other"
            for k, v in enumerate(reasons)}
    assert len(rows) == len(reasons) and labels == want
    assert len(calls.read_text().splitlines()) == 3


def test_failing_model_gives_fallbacks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "boom boom"), (2, "too expensive"), (3, "expensive")], "k int, churn_reason string")
    found = enrich_with_model(
        df, "churn_reason_category", _model(str(tmp_path / "c")), tasks=1).orderBy("k")
    assert [r["churn_reason_category"] for r in found.collect()] == ["other", "price", "price"]


@pytest.mark.parametrize("reply", [lambda ps: ps[:-1], lambda ps: [*ps, "more"], lambda ps: [{"a": 1} for _ in ps],
                                   lambda ps: None])
def test_replies_of_wrong_number_or_type_give_fallbacks(spark, reply):
    df = spark.createDataFrame([(i, f"reason number {i}") for i in range(5)], "k int, churn_reason string")
    found = enrich_with_model(df, "churn_reason_category", lambda: reply, tasks=1)
    assert [r["churn_reason_category"] for r in found.collect()] == ["other"] * 5


def test_explanations(spiky, tmp_path):
    found = anomalies(spiky.unionByName(spiky), keep=("ref",))
    answers = explain_anomalies(found, "d", ["value"], lambda: lambda ps: [f"because {len(p)}" for p in ps]).collect()
    assert len(answers) == 2 and {r["llm_explanation"][:7] for r in answers} == {"because"}
    failing = explain_anomalies(found, "d", ["value"], lambda: lambda ps: 1 / 0)
    assert [r["llm_explanation"] for r in failing.collect()] == [None, None]


def test_zscore_needs_no_ranks(spiky, monkeypatch):
    monkeypatch.setattr("ledgerfold.operators.outliers.order_statistics", None)
    assert [r["ref"] for r in zscore_anomalies(spiky, "mrr", keep=("ref",)).collect()] == ["k60"]
