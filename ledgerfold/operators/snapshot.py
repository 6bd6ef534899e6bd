"""Monthly snapshots of recurring revenue and churn.

A snapshot is an interval join of months with subscriptions. Rows enter only
through the pair (start month, churn month), so the table is first reduced to
one row per pair — one scan, combined before the shuffle, a few thousand rows
whatever the table size — and the interval logic runs on that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_exact
from .derive import is_decimal, mean_of, money_sum

MEASURES = (
    "mrr", "new_mrr", "expansion_mrr", "churned_mrr", "net_new_mrr", "active_customers",
    "new_customers", "churned_customers", "churn_rate", "arpu", "nrr",
)


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")


def month_period(df: DataFrame, start: str = "start_date") -> DataFrame:
    """The distinct start months, as text; gaps stay gaps."""
    months = df.select(month_of(F.col(start)).alias("m")).filter("m is not null").distinct()
    return months.select(F.date_format("m", "yyyy-MM").alias("period"))


# Floating amounts are added as decimals, which a running sum may subtract again without a trace; infinite ones are counted.
EXACT_AMOUNT = "decimal(38,10)"
INFINITE = ("up", "down")


def month_pairs(df: DataFrame, by: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """Row count, revenue and infinite amounts per start month and churn month.

    With `exact`, amounts are added to ten decimal places; an amount beyond
    10^28 that isn't infinite ends the job.
    """
    amount = F.col("mrr").cast("double")
    endless = (amount == float("inf"), amount == float("-inf")) if exact else (F.lit(False), F.lit(False))
    df = df.withColumns({k: x.cast("int") for k, x in zip(INFINITE, endless)})
    if exact:
        finite = F.when(F.abs(amount) < float("inf"), amount)
        df = df.withColumn("mrr", finite.cast(EXACT_AMOUNT))
    churn = F.col("churn_date") if "churn_date" in df.columns else F.lit(None).cast("timestamp_ntz")
    return (
        df.select(*by, "mrr", *INFINITE, month_of(F.col("start_date")).alias("s"), month_of(churn).alias("c"))
        .groupBy(*by, "s", "c")
        .agg(F.count(F.lit(1)).alias("n"), money_sum(F.col("mrr")).alias("v"),
             *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in INFINITE])
    )


def _running(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Signed changes per month, then a running sum over the months.

    A row leaves in its churn month, or in its start month when churn lies
    before it: then it was never active.
    """
    started = F.col("s").isNotNull()
    leaving = F.when(started, F.greatest("s", "c"))
    values = ("n", "v", *INFINITE)
    # month, whether it applies, and the sign of what it adds to the active, new and churned rows
    kinds = [
        (F.col("s"), started, 1, 1, 0),
        (leaving, F.col("c").isNotNull() & started, -1, 0, 0),
        (F.col("c"), F.col("c").isNotNull(), 0, 0, 1),
    ]
    entries = F.array(*[
        F.struct(F.when(applies, month).alias("m"), *[
            (F.col(x) * F.lit(sign)).alias(f"{part}_{x}")
            for part, sign in (("d", active), ("new", new), ("churn", churned)) for x in values])
        for month, applies, active, new, churned in kinds
    ])
    sums = [f"{part}_{x}" for part in ("d", "new", "churn") for x in values]
    monthly = (
        pairs.select(*by, F.inline(entries)).filter("m is not null")
        .groupBy(*by, "m").agg(*[F.sum(x).alias(x) for x in sums])
    )
    upto = (Window.partitionBy(*by).orderBy("m")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        monthly
        .withColumns({f"active_{x}": F.sum(f"d_{x}").over(upto) for x in values})
        .filter("new_n > 0")
    )


def _interval(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The interval join itself, between months and month pairs: a cross-check of the running form.

    A pair meets the months in which it counts, no others; with `by` the join is
    an equi-join on those columns and Spark picks the strategy.
    """
    periods = pairs.filter("s is not null").select(*[F.col(b).alias(f"p_{b}") for b in by],
                                                   F.col("s").alias("m")).distinct()
    same = [F.col(b).eqNullSafe(F.col(f"p_{b}")) for b in by]
    active = (F.col("s") <= F.col("m")) & (F.col("c").isNull() | (F.col("c") > F.col("m")))
    touches = active | (F.col("s") == F.col("m")) | (F.col("c") == F.col("m"))
    joined = pairs.join(periods, reduce(lambda a, b: a & b, same, touches))
    new, churned = F.col("s") == F.col("m"), F.col("c") == F.col("m")
    zero = F.lit(0).cast("bigint")

    def count(what: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(what))), zero)

    parts = {"active": active, "new": new, "churn": churned}
    return joined.groupBy(*by, "m").agg(*[a for part, where in parts.items() for a in (
        count("n", where).alias(f"{part}_n"), money_sum(F.col("v"), where).alias(f"{part}_v"),
        *[count(k, where).alias(f"{part}_{k}") for k in INFINITE])])


def _amount(part: str) -> Column:
    """The sum of floating amounts: exact if all are finite, else what floating addition gives."""
    up, down = (F.col(f"{part}_{k}") > 0 for k in INFINITE)
    return (F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf"))
            .otherwise(F.col(f"{part}_v").cast("double")))


def monthly_snapshot(
    df: DataFrame, by: tuple[str, ...] = (), form: str | None = None, rounded: bool = True,
) -> DataFrame:
    """One row per start month (and per `by`), with all measures.

    `form` is "running", which is linear in the month pairs, or "interval", which
    checks it; both give the same rows. Floating amounts are added exactly, to ten
    decimal places (what is smaller counts as 0), and come back as doubles. Of
    infinite ones the sums are infinite while they count, and NaN where both
    signs meet.
    """
    floating = not is_decimal(df, "mrr")
    return snapshot_of_pairs(month_pairs(df, by, exact=floating), by, form, rounded, floating)


def merge_pairs(parts: list[tuple[DataFrame, int]], by: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of all rows, from those of rows that came (with 1) and went (with -1).

    Exact, as counts and amounts are whole numbers and decimals. Pairs without rows are left out.
    """
    sums = ("n", "v", *INFINITE)
    signed = [pairs.select(*by, "s", "c", *[(F.col(x) * F.lit(sign)).alias(x) for x in sums]) for pairs, sign in parts]
    merged = reduce(DataFrame.unionByName, signed).groupBy(*by, "s", "c").agg(
        F.sum("n").alias("n"), F.sum("v").cast(EXACT_AMOUNT).alias("v"), *[F.sum(k).alias(k) for k in INFINITE])
    return merged.filter("n <> 0")


def snapshot_of_pairs(
    pairs: DataFrame, by: tuple[str, ...] = (), form: str | None = None, rounded: bool = True, floating: bool = True,
) -> DataFrame:
    """`monthly_snapshot` of the rows that the pairs were counted from."""
    months = {"running": _running, "interval": _interval}[form or "running"](pairs, by)
    if floating:
        months = months.withColumns({f"{part}_v": _amount(part) for part in ("active", "new", "churn")})
    active = F.greatest(F.col("active_n"), F.lit(1))
    base = F.col("active_v") - F.col("new_v") + F.col("churn_v")
    ratio = round_exact if rounded else (lambda c, digits: c)
    return months.select(
        *by,
        F.date_format("m", "yyyy-MM").alias("period"),
        F.col("active_v").alias("mrr"),
        F.col("new_v").alias("new_mrr"),
        F.lit(0.0).alias("expansion_mrr"),
        F.col("churn_v").alias("churned_mrr"),
        (F.col("new_v") - F.col("churn_v")).alias("net_new_mrr"),
        F.col("active_n").alias("active_customers"),
        F.col("new_n").alias("new_customers"),
        F.col("churn_n").alias("churned_customers"),
        ratio(mean_of(F.col("churn_n"), active), 4).alias("churn_rate"),
        ratio(mean_of(F.col("active_v"), active), 2).alias("arpu"),
        ratio(mean_of(F.col("active_v"), F.greatest(base.cast("double"), F.lit(1.0))) * 100, 2)
        .alias("nrr"),
    )


def single_snapshot(df: DataFrame, month: str | None = None) -> DataFrame:
    """The one row of a table without start dates."""
    active, churned = ~F.col("churned"), F.col("churned")
    period = F.lit(month) if month else F.date_format(F.current_date(), "yyyy-MM")
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(active).alias("active_n"), F.count_if(churned).alias("churn_n"),
        money_sum(F.col("mrr"), active).alias("active_v"),
        money_sum(F.col("mrr"), churned).alias("churn_v"),
        F.count(F.when(active, F.col("mrr"))).alias("valued"),
    )
    return totals.select(
        period.alias("period"),
        F.col("active_v").alias("mrr"),
        F.col("active_v").alias("new_mrr"),
        F.lit(0.0).alias("expansion_mrr"),
        F.col("churn_v").alias("churned_mrr"),
        (F.col("active_v") - F.col("churn_v")).alias("net_new_mrr"),
        F.col("active_n").alias("active_customers"),
        F.col("n").alias("new_customers"),
        F.col("churn_n").alias("churned_customers"),
        mean_of(F.col("churn_n"), F.col("n")).alias("churn_rate"),
        F.coalesce(mean_of(F.col("active_v"), F.col("valued")), F.lit(0.0)).alias("arpu"),
    )


def has_months(df: DataFrame) -> bool:
    return "start_date" in df.columns and not df.filter("start_date is not null").isEmpty()


def snapshots(df: DataFrame, month: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Monthly snapshots, from the rows' `pairs` if these are counted, or the single one if no start date is known."""
    if pairs is not None:
        return snapshot_of_pairs(pairs)
    if has_months(df):
        return monthly_snapshot(df)
    return single_snapshot(df, month).withColumn("nrr", F.lit(None).cast("double"))
