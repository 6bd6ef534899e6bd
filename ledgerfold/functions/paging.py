"""Pages by key: a page begins behind the last row of the one before.

The cursor is that row's sort key. It becomes a predicate that reaches the scan,
and the page a top-k, so that a late page costs no more than the first; an offset
sorts everything before the page. The last column of an order must tell rows
with equal other ones apart. Nulls come first, or last in a descending order, and
NaN above all numbers, as Spark sorts them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ref

Order = Sequence[tuple[str, bool]]  # column, and whether it descends


def sorted_by(order: Order) -> list[Column]:
    return [ref(c).desc() if down else ref(c).asc() for c, down in order]


def cursor_of(row: Row, order: Order) -> str:
    """The sort key of a row, to be given back for the rows behind it."""
    return json.dumps([None if row[c] is None else str(row[c]) for c, _ in order])


def _compared(name: str, down: bool, text: str | None, dtype: T.DataType) -> tuple[Column, Column]:
    """Whether a value comes later than the cursor's, and whether it is the same.

    NaN is asked for by name: file statistics leave it out, so a comparison alone
    could skip it.
    """
    value = ref(name)
    if text is None:
        return (F.lit(False) if down else value.isNotNull()), value.isNull()
    floating = isinstance(dtype, (T.DoubleType, T.FloatType))
    if floating and text.lower() == "nan":
        return (~F.isnan(value) | value.isNull() if down else F.lit(False)), F.isnan(value)
    last = F.lit(text).cast(dtype)
    if down:
        return (value < last) | value.isNull(), value == last
    return ((value > last) | F.isnan(value) if floating else value > last), value == last


def behind(schema: T.StructType, order: Order, cursor: str) -> Column:
    """Whether a row comes after the cursor's in the order."""
    parts = json.loads(cursor)
    if len(parts) != len(order):
        raise ValueError("a cursor of another order")
    after = F.lit(False)
    for (name, down), text in reversed(list(zip(order, parts))):
        later, same = _compared(name, down, text, schema[name].dataType)
        after = later | (same & after)
    # beside it the first column alone: a plain comparison, which file statistics can answer
    (name, down), text = order[0], parts[0]
    dtype = schema[name].dataType
    if text is None or isinstance(dtype, (T.DoubleType, T.FloatType)):
        return after
    last = F.lit(text).cast(dtype)
    return (((ref(name) <= last) | ref(name).isNull()) if down else ref(name) >= last) & after


def page(df: DataFrame, order: Order, limit: int, cursor: str | None = None) -> DataFrame:
    """The first `limit` rows of an order, or those behind a cursor."""
    rows = df if cursor is None else df.filter(behind(df.schema, order, cursor))
    return rows.orderBy(*sorted_by(order)).limit(limit)


def next_cursor(rows: Sequence[Row], order: Order, limit: int) -> str | None:
    """The cursor behind a collected page; None if it was the last."""
    return cursor_of(rows[-1], order) if len(rows) == limit else None


def nth_page(read: Callable[[str | None], DataFrame], order: Order, limit: int, n: int) -> DataFrame:
    """The n-th page (from 0 on) by following cursors; behind the last one there are no rows."""
    cursor = None
    for _ in range(n):
        cursor = next_cursor(read(cursor).collect(), order, limit)
        if cursor is None:
            return read(None).limit(0)
    return read(cursor)
