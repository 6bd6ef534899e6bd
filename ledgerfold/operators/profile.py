"""Schema detection and profiling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    NUMBER_TEXT, WHOLE_TEXT, as_number, as_whole, is_missing, number_of, ref, text_columns, whole_fits,
)
from ..settings import (
    CANONICAL_HINTS, DOMAIN_MIN_FIELDS, HIGH_NULL_WARNING, ID_LIKE_WARNING, NULL_RATIO_LIMIT,
)


def stack_rows(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry, without a second scan."""
    entries = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*entries)))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: dtype, rows, nulls, null ratio. One scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"n{i}")
          for i, f in enumerate(df.schema.fields)],
    )
    return stack_rows(counts, [
        {
            "column": F.lit(name),
            "dtype": F.lit(dtype),
            "rows": F.col("rows"),
            "nulls": F.col(f"n{i}"),
            "null_ratio": F.try_divide(
                F.col(f"n{i}").cast("double"), F.col("rows").cast("double")),
        }
        for i, (name, dtype) in enumerate(df.dtypes)
    ])


# --- Profile of stored files ---------------------------------------------------

# Types whose extremes the footers of Parquet files give as they are; a float's may leave out NaN, a text's may be cut.
FOOTER_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
FLOATS = (T.FloatType, T.DoubleType)
FILE_PROFILE = "column string, dtype string, rows bigint, nulls bigint, null_ratio double, minimum string, maximum string"


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row from the footers of Parquet files alone: `rows`, and per column its values and, of some types, extremes.

    The aggregate is pushed to the files, in a session of its own that reads them so.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    stored = own.read.parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("rows"), *[a for i, f in enumerate(stored.schema.fields) for a in (
        F.count(ref(f.name)).alias(f"n{i}"),
        *([F.min(ref(f.name)).alias(f"lo{i}"), F.max(ref(f.name)).alias(f"hi{i}")] if isinstance(f.dataType, FOOTER_TYPES) else []))])


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """`profile` of Parquet files, with extremes as text, from their footers.

    Only what these lack is scanned: floating columns, for NaN, which counts as
    null. Texts and nested columns have no extremes here.
    """
    stored = spark.read.parquet(path)
    seen = footer_counts(spark, path).first()
    floats = [(i, f.name) for i, f in enumerate(stored.schema.fields) if isinstance(f.dataType, FLOATS)]
    number = lambda c: F.nanvl(ref(c), F.lit(None).cast("double"))
    scanned = stored.agg(*[a for i, c in floats for a in (
        F.count(number(c)).alias(f"n{i}"), F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"))]).first() if floats else {}
    rows, total = [], seen["rows"] or 0  # without files there is no footer to sum
    for i, f in enumerate(stored.schema.fields):
        source = scanned if isinstance(f.dataType, FLOATS) else seen
        nulls = total - (source[f"n{i}"] or 0)
        ends = [None if f"{end}{i}" not in source or source[f"{end}{i}"] is None else str(source[f"{end}{i}"]) for end in ("lo", "hi")]
        rows.append((f.name, f.dataType.simpleString(), total, nulls, nulls / total if total else None, *ends))
    return spark.createDataFrame(rows, FILE_PROFILE)


# --- Findings ------------------------------------------------------------------

def nullable_columns(df: DataFrame) -> DataFrame:
    """Columns that hold at least one null."""
    return profile(df).filter("nulls > 0").select("column", "nulls")


def high_null_warnings(df: DataFrame, limit: float = NULL_RATIO_LIMIT) -> DataFrame:
    """A warning per column whose null ratio exceeds the limit."""
    share = F.format_number(F.col("null_ratio") * 100, 0)
    return profile(df).filter(F.col("null_ratio") > limit).select(
        "column",
        F.format_string(HIGH_NULL_WARNING, "column", share).alias("warning"),
    )


def id_like_columns(df: DataFrame) -> DataFrame:
    """Text columns whose values are all present and all different.

    Only columns without a null are counted, exactly, each by a group-by that is
    combined before the shuffle.
    """
    names = text_columns(df)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column string, warning string")
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    rows = seen["rows"]
    likely = [c for i, c in enumerate(names) if rows and seen[f"n{i}"] == rows]
    if not likely:
        return spark.createDataFrame([], "column string, warning string")
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), ref(c).alias("value")) for c in likely
    ])))
    return (
        values.groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count("one").alias("different"))
        .filter(F.col("different") == F.lit(rows))
        .select("column", F.format_string(ID_LIKE_WARNING, "column").alias("warning"))
    )


def domain_score(columns: list[str]) -> int:
    present = set(columns)
    return sum(not present.isdisjoint(hints) for hints in CANONICAL_HINTS.values())


def detect_domain(columns: list[str]) -> str:
    return "saas" if domain_score(columns) >= DOMAIN_MIN_FIELDS else "generic"


def canonical_mapping(columns: list[str]) -> dict[str, str]:
    """Found header -> canonical name.

    An exact canonical header wins; else the first header, in table order,
    among the hints.
    """
    mapping = {}
    for canonical, hints in CANONICAL_HINTS.items():
        found = canonical if canonical in columns else next((c for c in columns if c in hints), None)
        if found is not None:
            mapping[found] = canonical
    return mapping


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename; columns that are not mapped stay."""
    return df.withColumnsRenamed(mapping)


def sample_rows(df: DataFrame, order_by: list[str] | None = None, n: int = 3) -> DataFrame:
    """First rows; pass an order where the choice must be repeatable."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def infer_text_types(df: DataFrame) -> DataFrame:
    """Type all-text columns as a whole: boolean, whole number, double or text.

    A column takes a type only if every value present has it. Whole numbers are
    bigint or, where one is longer, decimal(38,0), so no digit is lost; with a
    longer one still the column stays text. One aggregate decides for all
    columns; nothing is sampled.
    """
    names = text_columns(df)
    if not names:
        return df
    # Each pattern is tried once on a text: whole numbers are sought among numbers, flags among other texts.
    texts = df.select(*[a for i, c in enumerate(names) for a in (
        ref(c).alias(f"v{i}"), ref(c).rlike(NUMBER_TEXT).alias(f"is{i}"))])
    kinds = texts.select(*texts.columns, *[
        (F.col(f"is{i}") & F.col(f"v{i}").rlike(WHOLE_TEXT)).alias(f"whole{i}") for i in range(len(names))])
    checks = []
    for i in range(len(names)):
        value, number, whole = F.col(f"v{i}"), F.col(f"is{i}"), F.col(f"whole{i}")
        flag = F.when(~number, value.rlike("^(True|TRUE|true|False|FALSE|false)$"))
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(flag).alias(f"b{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count_if(whole & whole_fits(value, "bigint", 18)).alias(f"l{i}"),
            F.count_if(whole & whole_fits(value, "decimal(38,0)", 38)).alias(f"e{i}"),
            F.count(F.when(number, number_of(value))).alias(f"d{i}"),
        ]
    seen = kinds.agg(*checks).first()
    typed = {}
    for i, c in enumerate(names):
        n = seen[f"n{i}"]
        if n == 0:
            continue
        if seen[f"b{i}"] == n:
            typed[c] = F.lower(ref(c)).cast("boolean")
        elif seen[f"w{i}"] == n:
            if seen[f"e{i}"] == n:
                typed[c] = as_whole(ref(c), "bigint" if seen[f"l{i}"] == n else "decimal(38,0)")
        elif seen[f"d{i}"] == n:
            typed[c] = as_number(ref(c), T.StringType())
    return df.withColumns(typed) if typed else df


@dataclass
class SchemaInfo:
    columns: list[str]
    dtypes: dict[str, str]
    detected_domain: str
    column_mapping: dict[str, str]
    nullable_columns: DataFrame
    sample_rows: DataFrame
    warnings: DataFrame


def detect_schema(df: DataFrame) -> SchemaInfo:
    """Everything above in one description; the frames in it are lazy."""
    warnings = high_null_warnings(df).unionByName(id_like_columns(df))
    return SchemaInfo(
        columns=df.columns,
        dtypes=dict(df.dtypes),
        detected_domain=detect_domain(df.columns),
        column_mapping=canonical_mapping(df.columns),
        nullable_columns=nullable_columns(df),
        sample_rows=sample_rows(df),
        warnings=warnings,
    )
