"""Exact order statistics without gathering a column in one task.

Spark's exact percentile holds every distinct value of a column in one buffer.
Here a sketch, which the caller's own statistics pass takes along, proposes a
narrow interval around each wanted rank. Then the rows below each interval and at its
ends are counted in one aggregate for all columns, and the copies of each value inside
it, combined before the shuffle. Intervals that would still hold too many values
are narrowed first, by passes of the same kind. The sketch only proposes: the
counts decide, and an interval that misses its rank is widened.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATHER_LIMIT = 2_000_000
GRID = 256
SKETCH_SIZE = 2048  # rank error about a third of a grid step
_POINTS = f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"


def sketch(value: Column) -> Column:
    """Evenly spaced approximate quantiles; null where there is no value."""
    quantiles = F.kll_sketch_get_quantile_double(
        F.kll_sketch_agg_double(value, SKETCH_SIZE), F.expr(_POINTS))
    return F.when(F.count(value) > 0, quantiles)


@dataclass(eq=False)
class _Target:
    """One wanted rank (0-based) of one column, with what is known about it."""

    column: str
    rank: int
    grid: list[float]              # approximate quantiles of the rows inside
    below: int                     # rows below those the grid covers
    inside: int                    # rows the grid covers
    floor: float = float("-inf")   # ends of the span the grid covers
    ceiling: float = float("inf")
    step: int = 1
    value: float | None = None

    @property
    def interval(self) -> tuple[str, float, float]:
        """The closed interval the grid proposes, up to the ends of its span."""
        at = floor((self.rank - self.below) / self.inside * GRID)
        first, last = at - self.step, at + 1 + self.step
        return (self.column, self.grid[first] if first >= 0 else self.floor,
                self.grid[last] if last <= GRID else self.ceiling)

    @property
    def spread(self) -> float:
        """About how many rows lie strictly inside the interval."""
        return self.inside * (2 * self.step + 1) / GRID

    def widen(self) -> None:
        self.step *= 4


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int],
    grids: dict[str, list[float]], gather_limit: int = GATHER_LIMIT,
) -> dict[tuple[str, int], float]:
    """Values at the given 0-based ranks among the non-null values.

    `counts` are the exact non-null counts and `grids` the sketches of the
    columns; columns must be doubles without NaN.
    """
    targets = [
        _Target(c, r, grids[c], 0, counts[c])
        for c, wanted in ranks.items() for r in sorted(set(wanted)) if 0 <= r < counts[c]
    ]
    while open_targets := [t for t in targets if t.value is None]:
        wide = [t for t in open_targets if t.spread > gather_limit]
        if wide:
            _narrow(df, wide)
        else:
            _gather(df, open_targets)
    return {(t.column, t.rank): t.value for t in targets}


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """One pass: counts at both ends of each interval, a sketch of its interior."""
    spans = list(dict.fromkeys(t.interval for t in targets))
    columns = []
    for i, (name, low, high) in enumerate(spans):
        c = F.col(name)
        columns += [
            F.count_if(c < F.lit(low)).alias(f"lt_low{i}"),
            F.count_if(c <= F.lit(low)).alias(f"le_low{i}"),
            F.count_if(c < F.lit(high)).alias(f"lt_high{i}"),
            F.count_if(c <= F.lit(high)).alias(f"le_high{i}"),
            sketch(F.when((c > F.lit(low)) & (c < F.lit(high)), c)).alias(f"grid{i}"),
        ]
    seen = df.agg(*columns).first()
    for t in targets:
        name, low, high = t.interval
        i = spans.index(t.interval)
        if seen[f"lt_low{i}"] <= t.rank < seen[f"le_low{i}"]:
            t.value = low
        elif seen[f"lt_high{i}"] <= t.rank < seen[f"le_high{i}"]:
            t.value = high
        elif seen[f"le_low{i}"] <= t.rank < seen[f"lt_high{i}"]:
            t.grid, t.step, t.floor, t.ceiling = seen[f"grid{i}"], 1, low, high
            t.below = seen[f"le_low{i}"]
            t.inside = seen[f"lt_high{i}"] - t.below
        else:
            t.widen()


def _merged(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint intervals in order, overlapping ones joined."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(set(intervals)):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _gather(df: DataFrame, targets: list[_Target]) -> None:
    """Read the ranks off a running sum over the copies of each value in the intervals.

    The rows below each interval and at its ends are counted in one plain
    aggregate, which settles ranks at an end; only values inside an interval that
    has other ranks are taken apart and counted. An interval is a group of its
    own, so no task holds more than one.
    """
    spans = [
        (c, low, high) for c in dict.fromkeys(t.column for t in targets)
        for low, high in _merged([t.interval[1:] for t in targets if t.column == c])
    ]
    ends = list(dict.fromkeys((t.column, end) for t in targets for end in t.interval[1:]))
    seen = df.agg(*[a for i, (c, end) in enumerate(ends) for a in (
        F.count_if(F.col(c) < F.lit(end)).alias(f"lt{i}"), F.count_if(F.col(c) <= F.lit(end)).alias(f"le{i}"))]).first()
    at = {x: (seen[f"lt{i}"], seen[f"le{i}"]) for i, x in enumerate(ends)}  # rows below an end, and up to it
    span_of, inner = {}, []
    for t in targets:
        i = span_of[t] = next(i for i, (c, low, high) in enumerate(spans)
                              if c == t.column and low <= t.interval[1] and t.interval[2] <= high)
        t.value = next((end + 0.0 for (c, end), (lt, le) in at.items()  # no negative zero, as in groups
                        if c == t.column and lt <= t.rank < le), None)
        if t.value is None and at[spans[i][:2]][1] <= t.rank < at[t.column, spans[i][2]][0]:
            inner.append(t)
        elif t.value is None:
            t.widen()
    if not inner:
        return
    wide = sorted({span_of[t] for t in inner})
    inside = {}
    for i in wide:
        c, low, high = spans[i]
        hit = (F.col(c) > F.lit(low)) & (F.col(c) < F.lit(high))
        inside[c] = inside[c].when(hit, F.lit(i)) if c in inside else F.when(hit, F.lit(i))
    entries = F.filter(
        F.array(*[F.struct(span.alias("span"), F.col(c).alias("v")) for c, span in inside.items()]),
        lambda x: x["span"].isNotNull())
    hits = df.filter(reduce(lambda a, b: a | b, [span.isNotNull() for span in inside.values()]))
    values = (
        hits.select(F.inline(entries)).groupBy("span", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    running = (Window.partitionBy("span").orderBy("v")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = {t: t.rank - at[spans[span_of[t]][:2]][1] for t in inner}
    wanted = reduce(lambda a, b: a | b, [
        (F.col("span") == span_of[t]) & (F.col("upto") > place[t]) & (F.col("upto") - F.col("n") <= place[t])
        for t in inner
    ])
    found = values.withColumn("upto", F.sum("n").over(running)).filter(wanted).collect()
    for t in inner:
        t.value = next(r["v"] for r in found if r["span"] == span_of[t] and r["upto"] - r["n"] <= place[t] < r["upto"])


def quantile_ranks(n: int, q: float) -> list[int]:
    """The one or two ranks a linearly interpolated quantile rests on."""
    if n == 0:
        return []
    at = q * (n - 1)
    return sorted({floor(at), min(floor(at) + 1, n - 1)})


def interpolate(n: int, q: float, at_rank) -> float | None:
    """Linear interpolation between neighbouring ranks."""
    if n == 0:
        return None
    at = q * (n - 1)
    low = floor(at)
    a, b = at_rank(low), at_rank(min(low + 1, n - 1))
    part = at - low
    if part == 0 or a == b:
        return a
    return b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part
