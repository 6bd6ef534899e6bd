"""Labels for plan, churn reason, industry and churn risk.

Two classifiers share guards, labels and fallbacks. The built-in one is a set
of expressions and runs inside the scan of the table, without a shuffle. The
pluggable one calls a user's model: once per distinct prompt, in batches, in
the workers.

The label rules of the built-in classifier are this package's own.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..functions.scratch import stage
from ..settings import (
    CHURNED_STATUSES, FILL_TEXT, INDUSTRY_FALLBACK, PLAN_FALLBACK, REASON_FALLBACK, RISK_FALLBACK,
)

PLAN_WORDS = {
    "custom": "custom|bespoke|negotiated",
    "enterprise": "enterprise|corporate|unlimited",
    "professional": "professional|business|premium|advanced",
    "growth": "growth|team|plus|standard",
    "starter": "starter|free|basic|trial|lite|personal",
}
# Upper revenue bound of a plan whose name says nothing.
PLAN_REVENUE = (("starter", 100), ("growth", 500), ("professional", 1000), ("enterprise", 5000))
REASON_WORDS = {
    "price": "expensive|price|pricing|cost|budget|cheap|afford",
    "competition": "competitor|competition|switched",
    "support": "support|response time|customer service",
    "usage": "not using|unused|usage|adoption|no longer need",
    "product": "feature|product|workflow|bug|missing|quality",
}
INDUSTRY_WORDS = {
    "tech": "tech|software|data|cloud|cyber|digital",
    "finance": "bank|capital|financ|invest|insur|credit",
    "healthcare": "health|medic|clinic|pharma|hospital",
    "retail": "retail|store|shop|furniture|household",
    "education": "school|universit|college|academy|educat",
    "manufacturing": "manufactur|factory|machin|automobile|steel",
    "media": "media|news|studio|film|press|broadcast",
}


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case and all else unchanged."""
    text = text.cast("string")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def by_words(text: Column, words: dict[str, str], fallback: Column | str, low: Column | None = None) -> Column:
    """First label with a word in the text, in any case.

    With `low`, the text's `ascii_lower` as a column of its own, plain words are
    sought in that, without a regular expression per label.
    """
    rules = None
    for label, pattern in words.items():
        if low is not None and re.fullmatch("[a-z |]+", pattern):
            hit = reduce(lambda a, b: a | b, [low.contains(word) for word in pattern.split("|")])
        else:
            hit = text.rlike(f"(?i){pattern}")
        rules = (F if rules is None else rules).when(hit, F.lit(label))
    return rules.otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def column_or(df: DataFrame, name: str, default: object) -> Column:
    """The column, or a constant where the table lacks it."""
    return ref(name) if name in df.columns else F.lit(default)


# --- Built-in classifier -----------------------------------------------------

def plan_category(plan: Column, mrr: Column | None = None, low: Column | None = None) -> Column:
    by_revenue: Column = F.lit(PLAN_FALLBACK)
    if mrr is not None:
        by_revenue = F.when(mrr.isNull(), F.lit(PLAN_FALLBACK))
        for label, bound in PLAN_REVENUE:
            by_revenue = by_revenue.when(mrr < F.lit(bound), F.lit(label))
        by_revenue = by_revenue.otherwise(F.lit("custom"))
    return F.when(plan.isNotNull(), by_words(plan, PLAN_WORDS, by_revenue, low))


def has_reason(reason: Column) -> Column:
    return reason.isNotNull() & (reason != FILL_TEXT) & (F.length(reason) > 3)


def churn_reason_category(reason: Column, low: Column | None = None) -> Column:
    return F.when(has_reason(reason), by_words(reason, REASON_WORDS, REASON_FALLBACK, low))


def industry_category(name: Column, low: Column | None = None) -> Column:
    return F.when(name.isNotNull(), by_words(name, INDUSTRY_WORDS, INDUSTRY_FALLBACK, low))


def churn_risk_score(df: DataFrame) -> Column:
    """Points out of a hundred from status, revenue, lifetime, seats and plan."""
    status = F.lower(column_or(df, "status", "").cast("string"))
    lifetime = column_or(df, "lifetime_months", None).cast("double")
    seats = column_or(df, "seats", None).cast("double")
    plan = F.lower(column_or(df, "plan", "").cast("string"))
    mrr = ref("mrr").cast("double")

    def points(n: int, where: Column) -> Column:
        return F.when(where, F.lit(n)).otherwise(F.lit(0))

    total = (
        F.lit(20) + points(60, status.isin(*CHURNED_STATUSES)) + points(15, status == "trial")
        + points(10, mrr < 100) + points(10, lifetime < 6) + points(10, seats < 5)
        + points(-10, plan.rlike(PLAN_WORDS["enterprise"]))
    )
    score = F.least(F.greatest(total, F.lit(0)), F.lit(100)) / F.lit(100.0)
    return F.when(mrr.isNull(), F.lit(RISK_FALLBACK)).otherwise(score.cast("double"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def enrich(df: DataFrame, max_rows: int | None = None, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Add every label the table's columns allow.

    `max_rows` with `order_by` labels only the first rows in that order, which
    must identify a row; the others get nulls.
    """
    if max_rows is not None:
        return enrich_head(df, max_rows, order_by)
    low = {c: f"lower case of {c}" for c in ("plan", "churn_reason", "customer_name") if c in df.columns}
    texts = df.withColumns({name: ascii_lower(F.col(c)) for c, name in low.items()}) if low else df
    added = {}
    if "plan" in df.columns:
        added["plan_category"] = plan_category(
            F.col("plan"), F.col("mrr") if "mrr" in df.columns else None, ref(low["plan"]))
    if "churn_reason" in df.columns:
        added["churn_reason_category"] = churn_reason_category(F.col("churn_reason"), ref(low["churn_reason"]))
    if "mrr" in df.columns:
        added["churn_risk_score"] = churn_risk_score(df)
    if "customer_name" in df.columns:
        added["industry_category"] = industry_category(F.col("customer_name"), ref(low["customer_name"]))
    return texts.withColumns(added).drop(*low.values()) if added else df


LABELS = ("plan_category", "churn_reason_category", "churn_risk_score", "industry_category")


def enrich_head(df: DataFrame, max_rows: int, order_by: tuple[str, ...]) -> DataFrame:
    """Labels on the first `max_rows` rows only, in the order of a unique key.

    The last key of the head is the limit; a repeated one there is an error, as
    the head would then be open.
    """
    if not order_by:
        raise ValueError("max_rows needs columns that order the rows: pass a unique key")
    labelled = enrich(df)
    labels = [c for c in LABELS if c in labelled.columns]
    # The last row of the head and the one behind it.
    edge = df.select(*order_by).orderBy(*order_by).offset(max_rows - 1).limit(2).collect() if max_rows > 0 else []
    if len(edge) == 2 and edge[0] == edge[1]:
        raise ValueError(f"{', '.join(order_by)} repeats at row {max_rows}: pass a unique key")
    in_head = F.lit(max_rows > 0)
    if len(edge) == 2:  # (a, b) <= (x, y), nulls first as in the order
        for name in reversed(order_by):
            last, value = F.lit(edge[0][name]).cast(df.schema[name].dataType), ref(name)
            below = F.lit(False) if edge[0][name] is None else value.isNull() | (value < last)
            in_head = below | (value.eqNullSafe(last) & in_head)
    return labelled.withColumns({c: F.when(in_head, F.col(c)) for c in labels})


LABEL_DEFAULTS = {
    "plan_category": PLAN_FALLBACK, "churn_reason_category": REASON_FALLBACK,
    "churn_risk_score": RISK_FALLBACK, "industry_category": INDUSTRY_FALLBACK,
}


def label_counts(columns: list[str]) -> list[Column]:
    """Aggregates: `rows`, and per label among the columns the rows that have one and those with the default."""
    present = [c for c in LABELS if c in columns]
    return [
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n_{c}") for c in present],
        *[F.count_if(F.col(c) == F.lit(LABEL_DEFAULTS[c])).alias(f"f_{c}") for c in present],
    ]


def label_report(seen: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """rows, field, labelled and fallbacks of each label, from its counts."""
    return [(seen["rows"], c, seen[f"n_{c}"], seen[f"f_{c}"]) for c in LABELS if f"n_{c}" in seen]


def enrichment_report(enriched: DataFrame) -> DataFrame:
    """Per label: rows that have one, and rows that fell back to the default."""
    counts = enriched.agg(*label_counts(enriched.columns))
    return counts.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("labelled"),
                 F.col(f"f_{c}").alias("fallbacks"))
        for c in LABELS if f"n_{c}" in counts.columns
    ])))


# --- Prompts -----------------------------------------------------------------
# One template per field; the reply keys are those `parse_replies` reads.

REPLY_KEYS = {
    "plan_category": "plan_category", "churn_reason_category": "category",
    "churn_risk_score": "churn_risk_score", "industry_category": "industry_category",
}
PROMPTS = {
    "plan_category": (
        "Which tier is this subscription plan: starter, growth, professional, enterprise or "
        "custom?\nPlan: {plan}\nMRR: {mrr}\nSeats: {seats}\n"
        'Reply in JSON: {"plan_category": tier, "confidence": 0 to 1}'
    ),
    "churn_reason_category": (
        "Why did this customer leave: price, product, competition, support, usage or other?\n"
        "Reason given: {churn_reason}\n"
        'Reply in JSON: {"category": reason, "sentiment": "negative" or "neutral", '
        '"confidence": 0 to 1}'
    ),
    "churn_risk_score": (
        "How likely is this customer to leave?\nPlan: {plan}\nMRR: {mrr}\n"
        "Lifetime months: {lifetime_months}\nCountry: {country}\nSeats: {seats}\n"
        "Status: {status}\n"
        'Reply in JSON: {"churn_risk_score": 0 to 1, "risk_level": "low", "medium" or "high", '
        '"main_factor": text}'
    ),
    "industry_category": (
        "Which industry is this company in: tech, finance, healthcare, retail, education, "
        "manufacturing, media or other?\nCompany: {customer_name}\nPlan: {plan}\n"
        "Country: {country}\n"
        'Reply in JSON: {"industry_category": industry, "confidence": 0 to 1}'
    ),
}
# What a prompt shows for a column the table lacks.
PROMPT_DEFAULTS = {
    "plan_category": {"plan": "", "mrr": "0", "seats": "unknown"},
    "churn_reason_category": {"churn_reason": ""},
    "churn_risk_score": {
        "plan": "unknown", "mrr": "0", "lifetime_months": "unknown", "country": "unknown",
        "seats": "unknown", "status": "unknown",
    },
    "industry_category": {"customer_name": "", "plan": "", "country": ""},
}
GUARDS: dict[str, Callable[[DataFrame], Column]] = {
    "plan_category": lambda df: column_or(df, "plan", None).isNotNull(),
    "churn_reason_category": lambda df: F.coalesce(
        has_reason(column_or(df, "churn_reason", None).cast("string")), F.lit(False)),
    "churn_risk_score": lambda df: F.lit("mrr" in df.columns),
    "industry_category": lambda df: column_or(df, "customer_name", None).isNotNull(),
}


def render_prompt(df: DataFrame, field: str, template: str | None = None) -> Column:
    """The prompt of one field; null where the row has nothing to classify.

    A null value prints as "nan".
    """
    defaults = PROMPT_DEFAULTS[field]
    pieces = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template or PROMPTS[field])):
        if i % 2 == 0:
            pieces.append(F.lit(part))
        elif part in df.columns:
            pieces.append(F.coalesce(ref(part).cast("string"), F.lit("nan")))
        else:
            pieces.append(F.lit(defaults.get(part, "unknown")))
    return F.when(GUARDS[field](df), F.concat(*pieces))


# --- Pluggable model ---------------------------------------------------------

Classifier = Callable[[list[str]], list[str]]
MODEL_BATCH = 50


def batch_classify(
    prompts: DataFrame, make_classifier: Callable[[], Classifier], batch_size: int = MODEL_BATCH,
) -> DataFrame:
    """Replies to a column `prompt`, one client per task, one call per batch.

    If a batch fails, or has another number of replies, its prompts are asked one
    by one; a prompt that fails alone, or whose reply isn't text, gets a null
    reply, and so the fallback label.
    """
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in prompts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = make_classifier()

        def ask(texts: list[str]) -> list[str | None]:
            try:
                replies = list(classify(texts))
                if len(replies) != len(texts):
                    raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
                return [r if isinstance(r, str) else None for r in replies]
            except Exception:
                if len(texts) == 1:
                    return [None]
                return [reply for text in texts for reply in ask([text])]

        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at:at + batch_size]
                yield part.assign(reply=ask(part["prompt"].tolist()))

    return prompts.mapInPandas(run, f"{others}, reply string")


def parse_reply(reply: Column, key: str, fallback: str | float) -> Column:
    """The value under `key` of a JSON reply, code fences allowed, or the fallback."""
    bare = F.regexp_replace(reply, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    value = F.from_json(bare, f"`{key}` string")[key]
    if isinstance(fallback, float):
        return F.coalesce(value.try_cast("double"), F.lit(fallback))
    return F.coalesce(value, F.lit(fallback))


def enrich_with_model(
    df: DataFrame, field: str, make_classifier: Callable[[], Classifier],
    template: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Label one field with a model: distinct prompts, replies, labels joined back.

    Prompts are few bytes but slow calls, so they are spread over `tasks` tasks
    (by default one per core), not by size. The replies are stored before they
    are used: no model is called twice when a later step is repeated.
    """
    fallback = {
        "plan_category": PLAN_FALLBACK, "churn_reason_category": REASON_FALLBACK,
        "churn_risk_score": RISK_FALLBACK, "industry_category": INDUSTRY_FALLBACK,
    }[field]
    asked = render_prompt(df, field, template)
    prompts = df.select(asked.alias("prompt")).filter("prompt is not null").distinct()
    prompts = prompts.repartition(
        tasks or df.sparkSession.sparkContext.defaultParallelism, "prompt")
    labels = stage(
        batch_classify(prompts, make_classifier).select(
            F.sha2("prompt", 256).alias("prompt_key"),
            parse_reply(F.col("reply"), REPLY_KEYS[field], fallback).alias(field)),
        "labels")
    # Rows meet their label by the prompt's digest: no prompt text is shuffled. A row
    # without a prompt gets a key that no label has, so that such rows spread over tasks;
    # a prompt that many rows share is split by the engine.
    nobody = F.concat(F.lit("none "), F.pmod(F.xxhash64(*map(ref, df.columns)), F.lit(65_536)).cast("string"))
    rows = df.withColumn("prompt_key", F.coalesce(F.sha2(asked, 256), nobody))
    return rows.join(labels, "prompt_key", "left").drop("prompt_key")
