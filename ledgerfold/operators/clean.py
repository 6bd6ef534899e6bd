"""Cleaning: drop sparse columns, deduplicate, cast, fill, cap — in that order.

Every decision rests on whole-table statistics. They are gathered for all
columns at once: one pass for null ratios, one over the deduplicated rows for
everything the casts, fills and caps need, and one for the exact ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    EXACT_DOUBLE, WHOLE_TEXT, as_flag, as_number, as_timestamp, as_whole, fits_whole, in_format, is_missing,
    is_number, is_text, nan_to_null, numeric_columns, ref, text_columns,
)
from ..functions.ranks import interpolate, order_statistics, quantile_ranks, sketch
from ..functions.scratch import stage, stored
from ..settings import (
    CAP_EXEMPT, CAP_IQR_MULTIPLIER, DATE_FORMATS, DATE_NAMES, DATE_SUFFIXES, FILL_TEXT, FLAG_NAMES,
    NULL_RATIO_LIMIT, NUMBER_NAMES, NUMBER_PREFIXES, NUMERIC_TEXT_RATIO, TRUE_TEXTS,
)


# --- Column classes ----------------------------------------------------------

def column_class(name: str) -> str:
    lower = name.lower()
    if lower in DATE_NAMES or lower.endswith(DATE_SUFFIXES):
        return "date"
    if lower in FLAG_NAMES:
        return "bool"
    if lower in NUMBER_NAMES or lower.startswith(NUMBER_PREFIXES):
        return "numeric"
    return "other"


def classify_columns(columns: list[str]) -> dict[str, str]:
    return {c: column_class(c) for c in columns}


def _of_class(df: DataFrame, wanted: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if column_class(f.name) == wanted]


# --- Single steps ------------------------------------------------------------

def high_null_columns(
    df: DataFrame, limit: float = NULL_RATIO_LIMIT, protect: tuple[str, ...] = (),
) -> tuple[list[str], int]:
    """Columns whose null ratio exceeds the limit, and the row count."""
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"n{i}")
          for i, f in enumerate(df.schema.fields)],
    ).first()
    rows = seen["rows"]
    dropped = [
        c for i, c in enumerate(df.columns)
        if rows and seen[f"n{i}"] / rows > limit and c not in protect
    ]
    return dropped, rows


def drop_high_null(
    df: DataFrame, limit: float = NULL_RATIO_LIMIT, protect: tuple[str, ...] = (),
) -> DataFrame:
    dropped, _ = high_null_columns(df, limit, protect)
    return df.select(*[ref(c) for c in df.columns if c not in dropped])


def dedup_rows(df: DataFrame, row_index: str | None = None) -> DataFrame:
    """Drop full-row copies, nulls being equal.

    Copies are combined before the shuffle, so a row repeated any number of
    times leaves each task once. `row_index` is a column that doesn't count:
    its smallest value among the copies stays.
    """
    df = nan_to_null(df)
    if row_index is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != row_index]
    return df.groupBy(*map(ref, rest)).agg(F.min(row_index).alias(row_index))


def date_forms(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> dict[str, tuple[tuple[str, ...], int]]:
    """Per text column of dates: the format that most of its non-ISO values have, and the values that none fits.

    One aggregate tries all formats on all columns; of equal ones the first wins.
    """
    names = [f.name for f in _of_class(df, "date") if is_text(f.dataType)]
    if not names:
        return {}
    counts = []
    for i in range(len(names)):
        other = F.col(f"o{i}")
        counts += [F.count(other).alias(f"o{i}"), *(
            F.count(in_format(other, form)).alias(f"o{i}_{j}") for j, form in enumerate(formats))]
    seen = df.select(*[
        F.when(as_timestamp(ref(c), T.StringType()).isNull(), ref(c)).alias(f"o{i}") for i, c in enumerate(names)]).agg(*counts).first()
    forms = {}
    for i, c in enumerate(names):
        hits = [seen[f"o{i}_{j}"] for j in range(len(formats))]
        best = max(range(len(formats)), key=lambda j: hits[j], default=None)  # noqa: B023
        found = hits[best] if best is not None else 0
        forms[c] = ((formats[best],) if found else (), seen[f"o{i}"] - found)
    return forms


def cast_dates(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Dates from ISO texts and from the one of `formats` that suits a column best."""
    forms = date_forms(df, formats)
    casts = {
        f.name: as_timestamp(ref(f.name), f.dataType, forms.get(f.name, ((), 0))[0]) for f in _of_class(df, "date")}
    return df.withColumns(casts) if casts else df


def cast_bools(df: DataFrame) -> DataFrame:
    casts = {f.name: as_flag(ref(f.name), f.dataType, TRUE_TEXTS) for f in _of_class(df, "bool")}
    return df.withColumns(casts) if casts else df


def cast_numerics(df: DataFrame) -> DataFrame:
    casts = {f.name: as_number(ref(f.name), f.dataType) for f in _of_class(df, "numeric")}
    return df.withColumns(casts) if casts else df


def _open_text(df: DataFrame) -> list[str]:
    return [f.name for f in _of_class(df, "other") if is_text(f.dataType)]


def _long_numbers(c: Column) -> Column:
    """Counts whole numbers that a double cannot hold; only long texts are looked at."""
    exact = as_whole(c, "decimal(38,0)")
    return F.count_if((F.length(c) > 15) & c.rlike(WHOLE_TEXT) & (exact.isNull() | (F.abs(exact) > EXACT_DOUBLE)))


def _numbers_of_texts(df: DataFrame, long: dict[str, bool], parsed: dict[str, int]) -> dict[str, Column | None]:
    """The numbers of text columns: doubles, or exact types where a double would lose digits.

    None for a column without a type that keeps all of them; it then stays text.
    One more aggregate is made only for columns with long numbers.
    """
    found: dict[str, Column | None] = {c: as_number(ref(c), T.StringType()) for c in long}
    names = [c for c in long if long[c]]
    if names:
        seen = df.agg(*[a for i, c in enumerate(names) for a in (
            F.count_if(fits_whole(ref(c), "bigint", 18)).alias(f"b{i}"),
            F.count_if(fits_whole(ref(c), "decimal(38,0)", 38)).alias(f"e{i}"))]).first()
        for i, c in enumerate(names):
            kind = "bigint" if seen[f"b{i}"] == parsed[c] else "decimal(38,0)"
            found[c] = as_whole(ref(c), kind) if seen[f"e{i}"] == parsed[c] else None
    return found


def infer_numeric_text(df: DataFrame, ratio: float = NUMERIC_TEXT_RATIO) -> DataFrame:
    """Other text columns become numbers if more than `ratio` of all rows parse.

    They become double, or bigint or decimal(38,0) where whole numbers are too long for that.
    """
    names = _open_text(df)
    if not names:
        return df
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(as_number(ref(c), T.StringType())).alias(f"p{i}") for i, c in enumerate(names)],
        *[_long_numbers(ref(c)).alias(f"l{i}") for i, c in enumerate(names)],
    ).first()
    likely = [(i, c) for i, c in enumerate(names) if seen["rows"] and seen[f"p{i}"] / seen["rows"] > ratio]
    numbers = _numbers_of_texts(
        df, {c: seen[f"l{i}"] > 0 for i, c in likely}, {c: seen[f"p{i}"] for i, c in likely})
    chosen = {c: number for c, number in numbers.items() if number is not None}
    return df.withColumns(chosen) if chosen else df


def fill_text_unknown(df: DataFrame) -> DataFrame:
    names = text_columns(df)
    return df.withColumns({c: F.coalesce(ref(c), F.lit(FILL_TEXT)) for c in names}) if names else df


def fill_numeric_median(df: DataFrame, known: dict[str, NumberStats] | None = None) -> DataFrame:
    """Nulls of numeric columns become the column's median: the exact one, or that of `known` statistics.

    What isn't a plain read of columns is stored once, for the passes over it.
    """
    rows = nan_to_null(df) if known else stored(nan_to_null(df), "filled")
    numbers = known or numeric_statistics(rows, numeric_columns(rows), staged=True)
    return _apply_numbers(rows, numbers, fill=True, cap=False)


def keep_null_dates(df: DataFrame) -> DataFrame:
    """Fill texts and numbers; dates keep their nulls."""
    return fill_text_unknown(fill_numeric_median(df))


def cap_outliers_iqr(
    df: DataFrame, multiplier: float = CAP_IQR_MULTIPLIER, exempt: tuple[str, ...] = CAP_EXEMPT,
    known: dict[str, NumberStats] | None = None,
) -> DataFrame:
    """Clip numeric columns to the fences; a column without outliers is unchanged.

    The quartiles are those of the values present: nulls neither count nor move.
    With `known` statistics the fences are theirs, and no pass is made.
    """
    rows = nan_to_null(df) if known else stored(nan_to_null(df), "capped")
    numbers = known or numeric_statistics(
        rows, numeric_columns(rows), multiplier=multiplier, exempt=exempt, filled=False, staged=True)
    return _apply_numbers(rows, numbers, fill=False, cap=True)


# --- Statistics of numeric columns -------------------------------------------

@dataclass
class NumberStats:
    """What filling and capping one numeric column needs."""

    rows: int
    present: int
    minimum: float | None
    maximum: float | None
    median: float | None = None
    low: float | None = None
    high: float | None = None

    @property
    def missing(self) -> int:
        return self.rows - self.present

    @property
    def has_outliers(self) -> bool:
        if self.low is None or self.minimum is None:
            return False
        return self.minimum < self.low or self.maximum > self.high


def _number_aggregates(value: Column, i: int) -> list[Column]:
    return [
        F.count(value).alias(f"n{i}"),
        F.min(value).alias(f"lo{i}"),
        F.max(value).alias(f"hi{i}"),
        sketch(value).alias(f"g{i}"),
    ]


def numeric_statistics(
    df: DataFrame, columns: list[str], multiplier: float = CAP_IQR_MULTIPLIER,
    exempt: tuple[str, ...] = CAP_EXEMPT, filled: bool = True, staged: bool = False,
) -> dict[str, NumberStats]:
    """Exact medians and fences of the columns, a few passes for all of them.

    The numbers are stored first, so that the input is evaluated once, unless it
    is `staged` already.
    """
    if not columns:
        return {}
    doubles = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    if not staged:
        doubles = stage(doubles, "numbers")
    seen = doubles.agg(
        F.count(F.lit(1)).alias("rows"),
        *[a for i in range(len(columns)) for a in _number_aggregates(F.col(f"c{i}"), i)],
    ).first()
    return _finish_statistics(doubles, columns, seen, multiplier, exempt, filled)


def _finish_statistics(doubles, columns, seen, multiplier, exempt, filled) -> dict[str, NumberStats]:
    """Ranks for medians and fences, from the first pass's counts.

    Filling puts k copies of the median into the column. The value at rank i
    of the filled column is then max(min(v[i], median), v[i-k]) over the sorted
    values v present, so one pass over the unfilled values serves both steps.
    """
    stats, ranks = {}, {}
    for i, c in enumerate(columns):
        n = seen[f"n{i}"]
        s = stats[c] = NumberStats(seen["rows"], n, seen[f"lo{i}"], seen[f"hi{i}"])
        wanted = ranks[f"c{i}"] = []
        k = s.missing if filled else 0
        if k:
            wanted += quantile_ranks(n, 0.5)
        if c.lower() not in exempt:
            for q in (0.25, 0.75):
                wanted += [r - d for r in quantile_ranks(n + k, q) for d in {0, k}]
    found = order_statistics(
        doubles, ranks,
        counts={f"c{i}": seen[f"n{i}"] for i in range(len(columns))},
        grids={f"c{i}": seen[f"g{i}"] for i in range(len(columns))},
    )
    for i, c in enumerate(columns):
        s = stats[c]
        if s.present == 0:
            continue
        k = s.missing if filled else 0
        if k:
            s.median = interpolate(s.present, 0.5, lambda r: found[f"c{i}", r])

        def at_rank(r: int) -> float:
            value = found.get((f"c{i}", r), float("inf"))
            if k:
                value = max(min(value, s.median), found.get((f"c{i}", r - k), float("-inf")))
            return value

        if c.lower() not in exempt:
            q1 = interpolate(s.present + k, 0.25, at_rank)
            q3 = interpolate(s.present + k, 0.75, at_rank)
            spread = q3 - q1
            if spread == spread:
                s.low, s.high = q1 - multiplier * spread, q3 + multiplier * spread
    return stats


def _apply_numbers(df: DataFrame, stats: dict[str, NumberStats], fill: bool, cap: bool) -> DataFrame:
    """Fill and clip; columns that need neither keep their type.

    So do whole numbers too long for a double: only the values that change are rounded.
    """
    changes = {}
    for c, s in stats.items():
        dtype = df.schema[c].dataType
        exact = isinstance(dtype, (T.IntegralType, T.DecimalType)) and s.present and (
            max(abs(s.minimum), abs(s.maximum)) > EXACT_DOUBLE)
        number = ref(c) if exact else ref(c).cast("double")
        limit = (lambda x: F.lit(x).cast(dtype)) if exact else F.lit  # noqa: B023
        if fill and s.missing and s.median is not None:
            changes[c] = F.coalesce(number, limit(s.median))
        if cap and s.has_outliers:
            number = changes.get(c, number)
            low, high = F.lit(s.low), F.lit(s.high)
            changes[c] = F.when(number < low, limit(s.low)).when(number > high, limit(s.high)).otherwise(number)
    return df.withColumns(changes) if changes else df


# --- The whole sequence ------------------------------------------------------

# Per capped column whether a row's value was outside; a name that no normalized header has.
OUTSIDE = "_Outside"


@dataclass
class CleanReport:
    original_rows: int
    final_rows: int
    duplicates_removed: int
    columns_dropped: list[str]
    type_conversions: dict[str, str]
    nulls_filled: dict[str, int]
    fences: dict[str, tuple[float, float]]
    outliers_capped: dict[str, int] = field(default_factory=dict)
    dates_lost: dict[str, int] = field(default_factory=dict)

    def stored(self) -> dict[str, object]:
        """What the registry keeps of it."""
        return {k: v for k, v in vars(self).items() if k != "fences"}


@dataclass
class CleanResult:
    frame: DataFrame
    typed: DataFrame
    partial: CleanReport
    finish: Callable[[DataFrame], DataFrame] | None = None  # from `typed` to `frame`
    lost_dates: DataFrame | None = None  # column_name and value of each, with the row's number if there are numbers

    def report(self) -> CleanReport:
        """Adds the outlier counts; one pass, only when asked for."""
        p = self.partial
        if p.fences and not p.outliers_capped:
            names = list(p.fences)
            seen = self.typed.agg(*[
                F.count_if((ref(c) < p.fences[c][0]) | (ref(c) > p.fences[c][1])).alias(f"o{i}")
                for i, c in enumerate(names)
            ]).first()
            p.outliers_capped = {c: seen[f"o{i}"] for i, c in enumerate(names)}
        return p

    def counted(self) -> tuple[DataFrame, list[Column]]:
        """`frame` with the column OUTSIDE, and aggregates of it for `with_counts`.

        So outliers are counted in whatever pass writes the rows.
        """
        fences = self.partial.fences
        if not fences:
            return self.frame, []
        outside = F.array(*[(ref(c) < low) | (ref(c) > high) for c, (low, high) in fences.items()])
        return self.finish(self.typed.withColumn(OUTSIDE, outside)), [
            F.count_if(F.get(OUTSIDE, F.lit(i))).alias(f"outside{i}") for i in range(len(fences))]

    def with_counts(self, seen: dict[str, int]) -> CleanReport:
        """The report with the outlier counts of a pass."""
        self.partial.outliers_capped = {c: seen[f"outside{i}"] for i, c in enumerate(self.partial.fences)}
        return self.partial

    def report_frame(self) -> DataFrame:
        """One row per column that was dropped, converted, filled or capped."""
        r = self.report()
        names = sorted({*r.columns_dropped, *r.type_conversions, *r.nulls_filled, *r.outliers_capped})
        rows = [
            (c, c in r.columns_dropped, r.type_conversions.get(c),
             r.nulls_filled.get(c, 0), r.outliers_capped.get(c, 0))
            for c in names
        ]
        return self.frame.sparkSession.createDataFrame(
            rows, "column string, dropped boolean, conversion string, "
                  "nulls_filled bigint, outliers_capped bigint")


def clean(
    df: DataFrame, null_ratio: float = NULL_RATIO_LIMIT, protect: tuple[str, ...] = (),
    numeric_ratio: float = NUMERIC_TEXT_RATIO, cap_multiplier: float = CAP_IQR_MULTIPLIER,
    date_formats: tuple[str, ...] = DATE_FORMATS, row_index: str | None = None,
) -> CleanResult:
    """The full sequence with its report.

    `row_index` is a column that numbers the rows: it stays as it is, and of
    copies of a row the smallest number is kept.
    """
    df = nan_to_null(df)
    number = [row_index] if row_index else []
    dropped, original = high_null_columns(df.drop(*number), null_ratio, protect)
    kept = df.select(*[ref(c) for c in df.columns if c not in [*dropped, *number]])
    # Texts that are or may be numbers are parsed once, beside the text.
    open_text = _open_text(kept)
    parsed = {
        f.name: f"parsed number of {f.name}" for f in kept.schema.fields
        if f.name in open_text or (column_class(f.name) == "numeric" and is_text(f.dataType))}
    distinct = dedup_rows(df.select(*map(ref, [*kept.columns, *number])), row_index)
    staged = stage(distinct.withColumns({
        name: as_number(ref(c), T.StringType()) for c, name in parsed.items()}), "distinct")
    rows = staged.select(*map(ref, kept.columns))
    forms = date_forms(rows, date_formats)

    # One pass: row count, parse counts of open text, statistics of every column
    # that is or may turn out numeric.
    conversions: dict[str, str] = {}
    typed: dict[str, Column] = {}
    candidates: dict[str, Column] = {}
    for f in rows.schema.fields:
        kind, c = column_class(f.name), ref(f.name)
        if kind == "date":
            typed[f.name], conversions[f.name] = as_timestamp(
                c, f.dataType, forms.get(f.name, ((), 0))[0]), "datetime"
        elif kind == "bool":
            typed[f.name], conversions[f.name] = as_flag(c, f.dataType, TRUE_TEXTS), "bool"
        elif kind == "numeric":
            typed[f.name] = ref(parsed[f.name]) if f.name in parsed else as_number(c, f.dataType)
            conversions[f.name] = "float"
            candidates[f.name] = typed[f.name]
        elif f.name in open_text:
            candidates[f.name] = ref(parsed[f.name])
        elif is_number(f.dataType):
            candidates[f.name] = c.cast("double")
    names = list(candidates)
    doubles = staged.select(
        *[candidates[c].alias(f"c{i}") for i, c in enumerate(names)],
        *[ref(c).alias(f"t{i}") for i, c in enumerate(open_text)],
    )
    seen = doubles.agg(
        F.count(F.lit(1)).alias("rows"),
        *[a for i in range(len(names)) for a in _number_aggregates(F.col(f"c{i}"), i)],
        *[F.count(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(open_text))],
        *[_long_numbers(F.col(f"t{i}")).alias(f"l{i}") for i in range(len(open_text))],
    ).first()
    total = seen["rows"]

    filled: dict[str, int] = {}
    likely = {
        c: seen[f"n{names.index(c)}"] for c in open_text
        if total and seen[f"n{names.index(c)}"] / total > numeric_ratio}
    long = {c: seen[f"l{open_text.index(c)}"] > 0 for c in likely}
    numbers_of = _numbers_of_texts(rows, long, likely)
    for i, c in enumerate(open_text):
        if numbers_of.get(c) is not None:
            typed[c] = numbers_of[c] if long[c] else ref(parsed[c])
            conversions[c] = "integer_inferred" if long[c] else "float_inferred"
        else:
            candidates.pop(c)
            if total - seen[f"t{i}"]:
                filled[c] = total - seen[f"t{i}"]
    numeric = [c for c in names if c in candidates]
    keep = {f"c{names.index(c)}": f"c{i}" for i, c in enumerate(numeric)}
    numbers = _finish_statistics(
        doubles.select(*[F.col(old).alias(new) for old, new in keep.items()]), numeric,
        {"rows": total, **{
            f"{p}{i}": seen[f"{p}{names.index(c)}"]
            for i, c in enumerate(numeric) for p in ("n", "lo", "hi", "g")}},
        cap_multiplier, CAP_EXEMPT, True,
    ) if numeric else {}
    filled |= {c: s.missing for c, s in numbers.items() if s.missing and s.median is not None}

    typed_frame = staged.select(*[typed.get(c, ref(c)).alias(c) for c in kept.columns], *number)
    typed_frame = _apply_numbers(typed_frame, numbers, fill=True, cap=False)
    report = CleanReport(
        original_rows=original, final_rows=total, duplicates_removed=original - total,
        columns_dropped=dropped, type_conversions=conversions, nulls_filled=filled,
        fences={c: (s.low, s.high) for c, s in numbers.items() if s.has_outliers},
        dates_lost={c: lost for c, (_, lost) in forms.items() if lost},
    )
    finish = lambda rows: fill_text_unknown(_apply_numbers(rows, numbers, fill=False, cap=True))
    result = CleanResult(finish(typed_frame), typed_frame, report, finish)
    if report.dates_lost:
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.when(typed[c].isNull(), ref(c)).alias("value")) for c in report.dates_lost])
        result.lost_dates = staged.select(*number, F.inline(cells)).filter("value is not null")
    return result
