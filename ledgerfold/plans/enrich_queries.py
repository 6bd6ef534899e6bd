"""Labels by the built-in rules and by a pluggable classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.derive import derive_lifetime
from ..operators.enrich import (
    INDUSTRY_WORDS, PLAN_REVENUE, PLAN_WORDS, REASON_WORDS, batch_classify,
    churn_reason_category, churn_risk_score, enrich, enrich_with_model, enrichment_report,
    industry_category, parse_reply, plan_category, render_prompt, risk_level,
)
from .fixtures import LIFETIME, SUBSCRIPTIONS, subscriptions, table
from .registry import query


def words_sql(text: str, words: dict[str, str], fallback: str) -> str:
    cases = " ".join(f"when regexp_matches(lower({text}), '{p}') then '{label}'"
                     for label, p in words.items())
    return f"case when {text} is null then null {cases} else {fallback} end"


_BY_REVENUE = ("case when mrr is null then 'unknown' "
               + " ".join(f"when mrr < {bound} then '{label}'" for label, bound in PLAN_REVENUE)
               + " else 'custom' end")
PLAN_SQL = words_sql("plan", PLAN_WORDS, _BY_REVENUE)
REASON_SQL = (f"case when churn_reason <> 'unknown' and length(churn_reason) > 3 then "
              f"{words_sql('churn_reason', REASON_WORDS, chr(39) + 'other' + chr(39))} end")
INDUSTRY_SQL = words_sql("customer_name", INDUSTRY_WORDS, "'other'")
RISK_SQL = f"""case when mrr is null then 0.5 else cast(least(greatest(20
  + case when status in ('churned', 'cancelled', 'canceled') then 60 else 0 end
  + case when status = 'trial' then 15 else 0 end + case when mrr < 100 then 10 else 0 end
  + case when lifetime_months < 6 then 10 else 0 end + case when seats < 5 then 10 else 0 end
  - case when regexp_matches(lower(plan), '{PLAN_WORDS['enterprise']}') then 10 else 0 end,
  0), 100) as double) / 100 end"""

# Order values scaled to plan prices, a plan name for some rows, and the segment
# in the customer's name.
_RATES = f"""with subs as ({SUBSCRIPTIONS}), rates as (select subscription_id,
    case subscription_id % 4 when 0 then 'Team Plus' when 1 then 'Basic' else plan end as plan,
    cast(mrr as double) / 100 as mrr, seats, status, country, churn_reason,
    concat(customer_name, ' ', industry) as customer_name, {LIFETIME} as lifetime_months from subs),
  labelled as (select *, {PLAN_SQL} as plan_category, {REASON_SQL} as churn_reason_category,
    {INDUSTRY_SQL} as industry_category, {RISK_SQL} as churn_risk_score from rates)"""
_LABELS = "plan_category, churn_reason_category, industry_category, churn_risk_score"


def _rates(spark, sf_dir):
    subs = derive_lifetime(subscriptions(spark, sf_dir))
    key = F.col("subscription_id") % 4
    return subs.select(
        "subscription_id",
        F.when(key == 0, "Team Plus").when(key == 1, "Basic").otherwise(F.col("plan")).alias("plan"),
        (F.col("mrr").cast("double") / 100).alias("mrr"), "seats", "status", "country",
        "churn_reason", F.concat_ws(" ", "customer_name", "industry").alias("customer_name"),
        "lifetime_months")


@query("enrich_plan_category", f"{_RATES} select subscription_id, plan_category from labelled")
def by_plan(spark, sf_dir):
    return _rates(spark, sf_dir).select(
        "subscription_id", plan_category(F.col("plan"), F.col("mrr")).alias("plan_category"))


@query("enrich_churn_reason", f"{_RATES} select subscription_id, churn_reason_category from labelled")
def by_reason(spark, sf_dir):
    return _rates(spark, sf_dir).select(
        "subscription_id", churn_reason_category(F.col("churn_reason")).alias("churn_reason_category"))


@query("enrich_churn_risk", f"""{_RATES} select subscription_id, churn_risk_score,
  case when churn_risk_score >= 0.7 then 'high' when churn_risk_score >= 0.4 then 'medium'
  else 'low' end as risk_level from labelled""")
def risk(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    scored = rates.select("subscription_id", churn_risk_score(rates).alias("churn_risk_score"))
    return scored.withColumn("risk_level", risk_level(F.col("churn_risk_score")))


@query("enrich_industry", f"{_RATES} select subscription_id, industry_category from labelled")
def by_industry(spark, sf_dir):
    return _rates(spark, sf_dir).select(
        "subscription_id", industry_category(F.col("customer_name")).alias("industry_category"))


@query("enrich", f"{_RATES} select subscription_id, {_LABELS} from labelled")
def all_labels(spark, sf_dir):
    return enrich(_rates(spark, sf_dir)).select("subscription_id", *_LABELS.split(", "))


@query("enrich_head", f"""{_RATES} select subscription_id, """ + ", ".join(
    f"case when rn <= 50 then {c} end as {c}" for c in _LABELS.split(", "))
    + " from (select *, row_number() over (order by subscription_id) as rn from labelled)")
def head(spark, sf_dir):
    labelled = enrich(_rates(spark, sf_dir), max_rows=50, order_by=("subscription_id",))
    return labelled.select("subscription_id", *_LABELS.split(", "))


@query("enrichment_report", f"""{_RATES}, fields as (
    select 'plan_category' as field, plan_category as label, 'unknown' as fallback from labelled
    union all select 'churn_reason_category', churn_reason_category, 'other' from labelled
    union all select 'industry_category', industry_category, 'other' from labelled
    union all select 'churn_risk_score', cast(churn_risk_score as varchar), '0.5' from labelled)
  select field, count(*) as rows, count(label) as labelled,
    count(case when label = fallback then 1 end) as fallbacks from fields group by field""")
def report(spark, sf_dir):
    return enrichment_report(enrich(_rates(spark, sf_dir)))


@query("render_prompts", f"""{_RATES} select subscription_id, concat(
  'Why did this customer leave: price, product, competition, support, usage or other?', chr(10),
  'Reason given: ', churn_reason, chr(10), 'Reply in JSON: ', '{{"category": reason, ',
  '"sentiment": "negative" or "neutral", "confidence": 0 to 1}}') as prompt
  from rates where churn_reason is not null""")
def prompts(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    return rates.select("subscription_id", render_prompt(rates, "churn_reason_category").alias(
        "prompt")).filter("prompt is not null")


def _stand_in():
    """A classifier that answers as a model would: fenced JSON, at times none."""

    def answer(prompt: str) -> str:
        given = prompt.split("Reason given: ", 1)[1].split("\n", 1)[0].lower()
        if "out of business" in given:
            return "I cannot tell."
        label = next((w for word, w in (("expensive", "price"), ("competitor", "competition"),
                                        ("features", "product"), ("support", "support"),
                                        ("not using", "usage")) if word in given), "other")
        return '```json\n{"category": "%s", "confidence": 0.9}\n```' % label

    return lambda batch: [answer(p) for p in batch]


_MODEL = REASON_SQL


@query("batch_classify", f"{_RATES} select subscription_id, {_MODEL} as churn_reason_category from rates")
def model(spark, sf_dir):
    """Distinct prompts to the classifier in batches, labels back to every row."""
    rates = _rates(spark, sf_dir).select("subscription_id", "churn_reason")
    return enrich_with_model(rates, "churn_reason_category", _stand_in).select(
        "subscription_id", "churn_reason_category")


@query("batch_replies", f"""{_RATES} select distinct churn_reason as reason,
  {_MODEL} as label from rates where churn_reason is not null""")
def replies(spark, sf_dir):
    """The classifier alone, on the distinct prompts."""
    asked = _rates(spark, sf_dir).filter("churn_reason is not null").select(
        F.col("churn_reason").alias("reason")).distinct().select(
        "reason", F.concat(F.lit("Reason given: "), "reason", F.lit("\n")).alias("prompt"))
    answered = batch_classify(asked, _stand_in)
    return answered.select("reason", parse_reply(F.col("reply"), "category", "other").alias("label"))


@query("parse_model_json", """select event_id,
  case when event_id % 4 = 3 then 'other' else event_type end as category,
  case when event_id % 4 = 3 then 0.5 else value end as score from events""")
def parsed(spark, sf_dir):
    """Replies bare, fenced, without the key, and broken."""
    body = F.format_string('{"category": "%s", "score": "%s"}', F.col("event_type"),
                           F.col("value").cast("string"))
    kind = F.col("event_id") % 4
    reply = (F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(kind == 2, F.concat(F.lit("```"), body, F.lit("```")))
             .when(F.col("event_id") % 8 == 3, F.lit('{"label": 1}')).otherwise(F.lit("sorry {")))
    return table(spark, sf_dir, "events").select(
        "event_id", parse_reply(reply, "category", "other").alias("category"),
        parse_reply(reply, "score", 0.5).alias("score"))
