"""Column expressions shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000
NUMBER_TEXT = (
    "^\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\\s*$")

WHOLE_TEXT = "^\\s*[+-]?[0-9]+\\s*$"
# Whole numbers up to here are exact as doubles.
EXACT_DOUBLE = 2**53


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def is_missing(name: str, dtype: T.DataType) -> Column:
    """Null, with NaN counted as null."""
    c = ref(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN into null, so that every later step sees one kind of gap."""
    changed = {
        f.name: F.nanvl(ref(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(changed) if changed else df


def as_number(c: Column, dtype: T.DataType) -> Column:
    """Double, or null where the value does not parse; infinities stay.

    Only texts that look like a number are cast. Spark's cast also takes Java
    literals ("1d", "0x1p3"), and pays for an exception on any other text.
    """
    if is_text(dtype):
        return F.when(c.rlike(NUMBER_TEXT), number_of(c))
    if isinstance(dtype, T.BooleanType) or is_number(dtype):
        value = c.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def number_of(c: Column) -> Column:
    """Double of a text that looks like a number, or null where it isn't one."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def as_whole(c: Column, dtype: str) -> Column:
    """A whole number written as text, exactly, or null where it isn't one or doesn't fit."""
    return F.when(c.rlike(WHOLE_TEXT), F.trim(c).try_cast(dtype))


def fits_whole(c: Column, dtype: str, digits: int) -> Column:
    """Whether a text is a whole number that fits; up to `digits` characters it does, so few are cast."""
    return c.rlike(WHOLE_TEXT) & whole_fits(c, dtype, digits)


def whole_fits(c: Column, dtype: str, digits: int) -> Column:
    """`fits_whole` of a text that is a whole number."""
    return (F.length(c) <= digits) | F.trim(c).try_cast(dtype).isNotNull()


def as_flag(c: Column, dtype: T.DataType, true_texts: tuple[str, ...]) -> Column:
    """True for the listed texts (exact case), for 1 and for true; else false."""
    if is_text(dtype):
        hit = c.isin(*true_texts)
    elif is_number(dtype):
        hit = c == F.lit(1)
    elif isinstance(dtype, T.BooleanType):
        hit = c
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


# What a date format's letters can match, in any width Java takes; wider than that, never narrower.
_YEAR, _MONTH, _DAY = "[+-]?[0-9]{4,19}", "0*([1-9]|1[0-2])", "0*([1-9]|[12][0-9]|3[01])"
_FORMAT_PARTS = {
    "yyyy": _YEAR, "M": _MONTH, "MM": _MONTH, "MMM": "[^0-9]+", "d": _DAY, "dd": _DAY,
    "H": "0*(1?[0-9]|2[0-3])", "HH": "0*(1?[0-9]|2[0-3])", "mm": "[0-5][0-9]", "ss": "[0-5][0-9]",
}


def format_shape(form: str) -> str | None:
    """A pattern that every text in a date format matches; None for formats with other letters or quotes."""
    parts = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", form)
    shape = []
    for first, more, other in parts:
        if other in ("'", "[", "]") or (first and first + more not in _FORMAT_PARTS):
            return None
        shape.append(re.escape(other) if other else _FORMAT_PARTS[first + more])
    return f"^{''.join(shape)}$"


def in_format(c: Column, form: str) -> Column:
    """Timestamp without zone of a text in a format, or null.

    A text that can't be in it isn't parsed: the parser pays for an exception on each.
    """
    shape, value = format_shape(form), F.try_to_timestamp(c, F.lit(form)).cast("timestamp_ntz")
    return value if shape is None else F.when(c.rlike(shape), value)


def as_timestamp(c: Column, dtype: T.DataType, formats: tuple[str, ...] = ()) -> Column:
    """Timestamp without zone, or null where the value does not parse.

    Texts may use any ISO form or one of `formats`; numbers are nanoseconds
    since the epoch.
    """
    if is_text(dtype):
        tries = [c.try_cast("timestamp_ntz")]
        tries += [in_format(c, f) for f in formats]
        return F.coalesce(*tries)
    if is_time(dtype):
        return c.cast("timestamp_ntz")
    if is_number(dtype):
        micros = F.floor(c.cast("double") / 1000).cast("bigint")
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", micros, epoch)
    return F.lit(None).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Full days from start to end, floored (also when negative)."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    day = F.lit(DAY_MICROS).cast("bigint")
    return ((micros - F.pmod(micros, day)) / day).cast("bigint")


def round_scaled(c: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as array libraries do."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def round_exact(c: Column, digits: int) -> Column:
    """Round half to even on the exact binary value.

    For small results only: it goes through text. Infinities stay.
    """
    text = F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))
    return F.when(F.abs(c) < F.lit(float("inf")), text.try_cast("double")).otherwise(c)


def percent_text(c: Column) -> Column:
    """Ratio as a percentage with two decimals; a missing ratio reads nan%."""
    text = F.replace(F.format_number(c * 100, 2), F.lit(","), F.lit(""))
    return F.concat(F.coalesce(text, F.lit("nan")), F.lit("%"))
