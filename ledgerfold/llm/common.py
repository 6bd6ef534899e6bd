"""What several operators share: row identity, words, and a bounded filter on rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stage

# What separates words, and the longest row filter.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
MOST_BITS = 1 << 30
BITS_PER_ROW = 16
SEGMENT_BITS = 1 << 15
# The columns that name a row; a column of the input with such a name is replaced.
KEY = ["_key_file", "_key_row"]


def named(name: str) -> Column:
    """Column `name`, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def positional(df: DataFrame) -> DataFrame:
    """`df` with its columns named c0, c1 and so on, so that no name clashes with a helper's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def _each_stored_row_once(df: DataFrame) -> bool:
    """Whether `df` is a scan under projections and filters: a row of it is a row of a file, and always the same ones."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def with_row_key(df: DataFrame) -> DataFrame:
    """`df` with the columns KEY (long), which name a row of the stored input.

    They are the same in every scan and after a lost executor, also for repeated
    rows. A frame that isn't a plain read of files, such as a join, a union or an
    exploded one, is written once, so that each of its rows gets a key of its own.
    """
    keys = (F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))
    plain = df.select(*(named(c) for c in df.columns if c not in KEY))
    if _each_stored_row_once(plain):
        try:
            return plain.select("*", *keys)
        except AnalysisException:  # these files have no row numbers
            pass
    return stage(plain, "rows").select("*", *keys)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """The rows of an Arrow batch in groups whose `column` has about that many bytes, one row at least.

    A task then holds few rows as Python objects at once, however long they are.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if start < stop:
            yield batch.slice(start, stop - start)


def give_back() -> None:
    """Return the process's free memory to the system: a worker waits with it for its next task, beside the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the usual library's; others return it themselves
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that gives its memory back when it is done."""
    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def filter_table(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap in which the slots of all `keys` (one long column) are set, and few others.

    It has at most 128 MB, whatever the number of keys: beyond that it lets more
    other rows through, and an exact step follows in any case.
    """
    bits = SEGMENT_BITS
    while bits < min(MOST_BITS, BITS_PER_ROW * count):
        bits *= 2
    slot = F.pmod(named(keys.columns[0]), F.lit(bits)) + 1
    segments = (
        keys.groupBy(F.bitmap_bucket_number(slot).alias("segment"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for segment, part in segments.collect():
        at = (segment - 1) * SEGMENT_BITS // 8
        bitmap[at:at + len(part)] = np.frombuffer(part, np.uint8)
    return bitmap


def set_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of the values (int64) whether its slot is set."""
    at = np.mod(values, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def in_filter(keys: DataFrame, count: int):
    """A test of long columns that is true for all `keys` and for few other values."""
    shared = keys.sparkSession.sparkContext.broadcast(filter_table(keys, count))

    @F.arrow_udf("boolean")
    def may_be_in(values: pa.Array) -> pa.Array:
        return pa.array(set_in(shared.value, values.to_numpy()))

    return may_be_in


def rows_in(df: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of `df` (with row keys) whose key is in `keys`, with the columns of `keys`.

    `keys` holds each row key once. Only rows that pass a bounded filter
    are shuffled.
    """
    may_be_in = in_filter(keys.select(F.xxhash64(*KEY)), keys.count())
    return df.filter(may_be_in(F.xxhash64(*KEY))).join(keys, KEY, how)


def left_join_few(df: DataFrame, marks: DataFrame) -> DataFrame:
    """`df` (with row keys) left joined with `marks`, which has some row keys, each once.

    Rows that the bounded filter clears don't move.
    """
    may_be_in = in_filter(marks.select(F.xxhash64(*KEY)), marks.count())
    tested = df.withColumn("_maybe", may_be_in(F.xxhash64(*KEY)))
    clear, doubtful = tested.filter(~F.col("_maybe")), tested.filter("_maybe")
    return clear.unionByName(doubtful.join(marks, KEY, "left"), allowMissingColumns=True).drop("_maybe")


def rows_not_in(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `df` (with row keys) whose key isn't in `keys`."""
    marked = left_join_few(df, stage(keys.select(*KEY, F.lit(True).alias("_marked")), "dropped"))
    return marked.filter(F.col("_marked").isNull()).drop("_marked")
