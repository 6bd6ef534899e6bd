"""Readers: delimited text, JSON records, SQL and Parquet."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref
from ..functions.scratch import stage, stage_counted
from ..operators.profile import infer_text_types
from ..settings import FILE_SUFFIXES, NO_VALUE_TEXTS, REJECT_JSON, REJECT_LINE, REJECT_NO_OBJECT, REJECT_NO_RECORDS

DELIMITERS = (",", ";", "\t", "|")
_BAD = "_unparsed_line"
REJECTED = "_rejected_line"
# Columns of a landed table: a record's number in the source; where it was read. Names that no normalized header has.
ROW_INDEX = "_Row_Index"
PLACE = ("_Place_File", "_Place_Split", "_Place_Record")
# Parameter: splits or files of a source, of 50 bytes or so each, up to which their offsets are broadcast.
MOST_SPLITS = 1_000_000


# --- Headers -----------------------------------------------------------------

def normalize_header(name: str, dots: bool = False) -> str:
    clean = name.strip().lower().replace(" ", "_").replace("-", "_")
    return clean.replace(".", "_") if dots else clean


def distinct_headers(names: list[str]) -> list[str]:
    """Names that are equal get numbers, from the second on, that no other name has."""
    out: list[str] = []
    for name in names:
        new, n = name, 2
        while new in out or (new != name and new in names):
            new, n = f"{name}_{n}", n + 1
        out.append(new)
    return out


def normalize_headers(df: DataFrame, dots: bool = False) -> DataFrame:
    """Lower-cased headers without blanks and hyphens; only metadata changes."""
    return df.toDF(*distinct_headers([normalize_header(c, dots) for c in df.columns]))


# --- Delimited text ----------------------------------------------------------

def sniff_delimiter(header: str) -> str:
    """The delimiter that splits the header line into most fields."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=bare.count)


def _header_line(spark: SparkSession, path: str) -> str:
    line = spark.read.text(path).first()
    if line is None or not line[0].strip():
        raise ValueError(f"empty source: {path}")
    return line[0].lstrip("﻿")


def _too_long(line: Column, sep: str, fields: int) -> Column:
    """More fields than the header: count delimiters outside quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    found = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
    return found >= fields


def read_csv(
    spark: SparkSession, path: str, sep: str | None = None, infer: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Delimited text with a header line.

    Rows with more fields than the header are skipped, shorter ones are padded
    with nulls; the usual texts for "no value" are null as well. Without `sep` the
    delimiter is read off the header. `infer`
    types each column as a whole; without it all columns stay text and no
    extra pass is made. Only `multiline` files, whose quoted fields may hold
    line breaks, are not split.
    """
    records, names = _csv_records(spark, path, sep, multiline)
    rows = records.filter(F.col(REJECTED).isNull()).select(*map(ref, names))
    return infer_text_types(rows) if infer else rows


def _csv_records(spark: SparkSession, path: str, sep: str | None, multiline: bool) -> tuple[DataFrame, list[str]]:
    """All records as text, with REJECTED: the line of a record with too many fields; and the names of the columns."""
    header = _header_line(spark, path)
    sep = sep or sniff_delimiter(header)
    names = distinct_headers([normalize_header(n) for n in next(csv.reader([header], delimiter=sep))])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
                          + [T.StructField(_BAD, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE",
                 columnNameOfCorruptRecord=_BAD, enforceSchema=True, multiLine=multiline,
                 columnPruning=False)
        .csv(path)
    )
    # The reader flags short and long rows alike; only the long ones go. It does
    # so only when it parses whole rows, and the flag cannot be read alone:
    # hence no pruning, and the first field in the test.
    keep = F.when(F.col(_BAD).isNull(), F.lit(True)).otherwise(
        ~_too_long(F.col(_BAD), sep, len(names)) | (F.length("c0") < 0))
    records = raw.select(*[
        F.when(~F.col(f"c{i}").isin(*NO_VALUE_TEXTS), F.col(f"c{i}")).alias(n)
        for i, n in enumerate(names)
    ], F.when(~keep, F.col(_BAD)).alias(REJECTED))
    return records, names


def read_tsv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    return read_csv(spark, path, sep="\t", infer=infer)


# --- JSON records ------------------------------------------------------------

def _flat_columns(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[Column]:
    """Leaves of nested structs, named by their dotted path; arrays stay whole."""
    leaves = []
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            leaves += _flat_columns(f.dataType, path)
        else:
            leaves.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
    return leaves


def flatten_records(df: DataFrame) -> DataFrame:
    """Nested structs to columns with normalized names."""
    return normalize_headers(df.select(*_flat_columns(df.schema)), dots=True)


def read_json_records(
    spark: SparkSession, path: str, data_key: str | None = None,
    schema: T.StructType | str | None = None, multiline: bool = False,
) -> DataFrame:
    """Landed JSON payloads: one document per line, or per file with `multiline`.

    `data_key` is a dotted path to the records: a list gives a row per item, an
    object one row, anything else is an error. Pass `schema` to spare the pass
    that infers it.
    """
    reader = spark.read.option("multiLine", multiline)
    raw = (reader.schema(schema) if schema else reader).json(path)
    if not data_key:
        return flatten_records(raw)
    dtype: T.DataType = raw.schema
    for part in data_key.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise KeyError(data_key)
        dtype = dtype[part].dataType
    records = F.col(".".join(f"`{p}`" for p in data_key.split(".")))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        rows = raw.select(F.inline(records))
    elif isinstance(dtype, T.StructType):
        rows = raw.select(records.alias("r")).select("r.*")
    else:
        raise ValueError(f"cannot read {dtype.simpleString()} at {data_key} as records")
    return flatten_records(rows)


# --- JSON records of drifting types --------------------------------------------

_RECORD = "_record"


def _variant_path(parts: tuple[str, ...]) -> str:
    """The path of nested keys; a key with both kinds of quotes has none."""
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in parts)


def _json_payloads(spark: SparkSession, path: str, data_key: str | None, multiline: bool) -> DataFrame:
    """One row per record, as VARIANT, or per payload without records, with REJECTED: why; and the payload's text."""
    lines = spark.read.text(path, wholetext=multiline).filter(F.trim("value") != "")
    payload = F.try_parse_json("value")
    at = F.try_variant_get(payload, _variant_path(tuple(data_key.split(".")) if data_key else ()), "variant")
    found = lines.select("value", payload.isNotNull().alias("parsed"), at.alias("at"), F.schema_of_variant(at).alias("kind"))
    listed = F.col("kind").startswith("ARRAY")
    each = F.when(listed, F.try_variant_get("at", "$", "array<variant>")).otherwise(F.array("at"))
    records = found.select("value", "parsed", F.explode_outer(each).alias(_RECORD), (listed & (F.size(each) == 0)).alias("none"))
    reason = (
        F.when(~F.col("parsed"), F.lit(REJECT_JSON))
        .when(F.col(_RECORD).isNull(), F.lit(REJECT_NO_RECORDS))
        .when(~F.schema_of_variant(_RECORD).startswith("OBJECT"), F.lit(REJECT_NO_OBJECT)))
    return records.filter(~F.coalesce("none", F.lit(False))).select(
        _RECORD, reason.alias(REJECTED), F.when(reason.isNotNull(), F.col("value")).alias("line"))


def _variant_leaves(dtype: T.StructType, prefix: tuple[str, ...] = ()) -> list[Column]:
    """The columns of nested objects by their dotted paths; what has several types is text, as JSON if it isn't plain."""
    leaves = []
    for f in dtype.fields:
        parts = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            leaves += _variant_leaves(f.dataType, parts)
            continue
        path, text = _variant_path(parts), f.dataType.simpleString()
        if isinstance(f.dataType, T.DecimalType):
            value = F.try_variant_get(_RECORD, path, "double" if f.dataType.precision <= 15 else text)
        elif "variant" in text or isinstance(f.dataType, (T.NullType, T.StructType)):
            inner = F.try_variant_get(_RECORD, path, "variant")
            plain = ~F.schema_of_variant(inner).rlike("^(OBJECT|ARRAY)")
            value = F.when(plain, F.try_variant_get(_RECORD, path, "string")).otherwise(F.to_json(inner))
        else:
            value = F.try_variant_get(_RECORD, path, text)
        leaves.append(value.alias(".".join(parts)))
    return leaves


def _variant_columns(stored: DataFrame) -> list[Column]:
    """What the records' merged schema makes of them; one aggregate over parsed values, no text is read again."""
    merged = stored.filter(F.col(REJECTED).isNull()).agg(F.schema_of_variant_agg(_RECORD)).first()[0]
    if merged is None or not merged.startswith("OBJECT<"):
        return []
    dtype = T.DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", merged))
    leaves = _variant_leaves(dtype)
    names = [".".join(p) for p in _leaf_paths(dtype)]
    return [c.alias(n) for c, n in zip(leaves, distinct_headers([normalize_header(n, dots=True) for n in names]))]


def _leaf_paths(dtype: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    return [p for f in dtype.fields for p in (
        _leaf_paths(f.dataType, (*prefix, f.name)) if isinstance(f.dataType, T.StructType) and f.dataType.fields
        else [(*prefix, f.name)])]


def read_json_mixed(
    spark: SparkSession, path: str, data_key: str | None = None, multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Landed JSON payloads whose shapes differ, read once: rows, and rejects (line, reason).

    At `data_key` a payload may have a list of records, or one; what is neither,
    or no JSON, is rejected. A value that is a number here and a text there is a
    text column. An empty list has no records.
    """
    stored = stage(_json_payloads(spark, path, data_key, multiline), "payloads")
    rows = stored.filter(F.col(REJECTED).isNull()).select(*_variant_columns(stored))
    return rows, stored.filter(F.col(REJECTED).isNotNull()).select("line", F.col(REJECTED).alias("reason"))


# --- SQL ---------------------------------------------------------------------

def jdbc_options(
    url: str, query: str, split: tuple[str, object, object, int] | None = None,
    fetch_size: int = 10_000, **more: str,
) -> dict[str, str]:
    """Options of a JDBC read; `split` is (column, lower, upper, partitions).

    It is required: without it a single task would read the whole result.
    """
    options = {"url": url, "fetchsize": str(fetch_size), **more}
    if split is None:
        raise ValueError("name a column to split the result by: (column, lower, upper, partitions)")
    column, lower, upper, partitions = split
    return options | {
        "dbtable": f"({query}) source", "partitionColumn": column, "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(partitions),
    }


def read_sql(
    spark: SparkSession, query: str, url: str | None = None,
    split: tuple[str, object, object, int] | None = None, **more: str,
) -> DataFrame:
    """Result of a given SELECT: on the database at `url`, else on Spark's catalog."""
    if not query:
        raise ValueError("no query given")
    if url is None:
        return normalize_headers(spark.sql(query))
    reader = spark.read.format("jdbc").options(**jdbc_options(url, query, split, **more))
    return normalize_headers(reader.load())


# --- Dispatch ----------------------------------------------------------------

def check_suffix(path: str) -> str:
    """The file type by name; a path without one is a folder of parts."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix and suffix not in FILE_SUFFIXES:
        raise ValueError(f"cannot read {suffix} files, only {', '.join(FILE_SUFFIXES)}")
    return suffix


def _read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    tabs = check_suffix(path) == ".tsv"
    return (read_tsv if tabs else read_csv)(spark, path, **options)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": _read_file,
    "tsv": read_tsv,
    "json": read_json_records,
    "api": read_json_records,
    "sql": read_sql,
    "jdbc": read_sql,
    "parquet": lambda spark, path: normalize_headers(spark.read.parquet(path)),
}


def read_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """Read by kind, in any case."""
    reader = READERS.get(kind.lower())
    if reader is None:
        raise ValueError(f"no reader for {kind}; there are {', '.join(READERS)}")
    return reader(spark, **options)


TEXT_KINDS = ("csv", "tsv")
JSON_KINDS = ("json", "api")


@dataclass
class Landed:
    """A source as it was read: its rows with ROW_INDEX, and the records that are no rows."""

    frame: DataFrame
    records: int
    rejects: DataFrame | None = None
    rejected: int = 0


def _placed(df: DataFrame) -> DataFrame:
    """`df` with where a record was read: file, place of the split in it, and a number that rises within the split."""
    place = F.monotonically_increasing_id().alias(PLACE[2])
    try:
        return df.select("*", F.col("_metadata.file_path").cast("binary").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]), place)
    except AnalysisException:  # not from files: by partition
        return df.select("*", F.lit(b"").alias(PLACE[0]), F.spark_partition_id().cast("long").alias(PLACE[1]), place)


def _offsets(counts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """`counts` with `offset_`: the records in all before, in that order. Few rows, one per split or file."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return stage(counts.withColumn("offset_", F.coalesce(F.sum("records").over(before), F.lit(0))), "offsets")


def _join_offsets(placed: DataFrame, offsets: DataFrame, on: tuple[str, ...], splits: int) -> DataFrame:
    """`placed` with ROW_INDEX instead of its place."""
    few = F.broadcast(offsets) if splits <= MOST_SPLITS else offsets
    return placed.join(few, list(on)).withColumn(
        ROW_INDEX, F.col("offset_") + F.col(PLACE[2])).drop(*PLACE, "offset_")


def number_records(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """`rows` of the table `stored`, with ROW_INDEX instead of PLACE: a record's number in the source, from 0 on.

    Two passes: the records of each split are counted, running sums over the
    splits in order of files give their offsets, and a record's number is its
    split's offset and its place there. Only one row per split is shuffled.
    """
    splits = stored.groupBy(*PLACE[:2]).agg(F.count(F.lit(1)).alias("records"), F.min(PLACE[2]).alias("first"))
    offsets = _offsets(splits, PLACE[:2])
    return _join_offsets(rows, offsets.select(*PLACE[:2], (F.col("offset_") - F.col("first")).alias("offset_")), PLACE[:2], offsets.count())


def land_source(spark: SparkSession, kind: str, **options) -> Landed:
    """Read a source once into a columnar table, number its records, and type its text columns there.

    The statistics passes to come then read single columns instead of parsing
    text, or asking a database, again. In the one pass over delimited text,
    records with too many fields go to `rejects` (ROW_INDEX, line, reason), and
    they count in the numbers. Records of several files are numbered in order of
    paths. Parquet is used where it lies, with the same numbers.
    """
    kind = kind.lower()
    if kind == "parquet":
        frame, records = _numbered_parquet(read_source(spark, kind, **options))
        return Landed(frame, records)
    if kind in JSON_KINDS and options.pop("mixed", False):
        payloads = _json_payloads(
            spark, options["path"], options.get("data_key"), options.get("multiline", False))
        stored, seen = stage_counted(
            _placed(payloads), "landed", F.count(F.lit(1)).alias("n"), F.count(REJECTED).alias("rejected"))
        numbered = number_records(stored, stored)
        frame = numbered.filter(F.col(REJECTED).isNull()).select(*_variant_columns(stored), ROW_INDEX)
        rejects = numbered.filter(F.col(REJECTED).isNotNull()).select(ROW_INDEX, "line", F.col(REJECTED).alias("reason"))
        return Landed(frame, seen["n"] - seen["rejected"], rejects if seen["rejected"] else None, seen["rejected"])
    if kind not in TEXT_KINDS:
        stored, seen = stage_counted(_placed(read_source(spark, kind, **options)), "landed", F.count(F.lit(1)).alias("n"))
        return Landed(number_records(stored, stored), seen["n"])
    path, sep = options.pop("path"), options.pop("sep", None)
    if kind == "tsv" or check_suffix(path) == ".tsv":
        sep = "\t"
    records, names = _csv_records(spark, path, sep, options.pop("multiline", False))
    if options:
        raise TypeError(f"no such options: {', '.join(sorted(options))}")
    stored, seen = stage_counted(
        _placed(records), "landed", F.count(F.lit(1)).alias("n"), F.count(REJECTED).alias("rejected"))
    rows = (stored.filter(F.col(REJECTED).isNull()) if seen["rejected"] else stored).drop(REJECTED)
    frame = number_records(infer_text_types(rows), stored)
    if not seen["rejected"]:
        return Landed(frame, seen["n"])
    lines = number_records(stored.filter(F.col(REJECTED).isNotNull()).select(REJECTED, *PLACE), stored)
    rejects = lines.select(ROW_INDEX, F.col(REJECTED).alias("line"), F.lit(REJECT_LINE % len(names)).alias("reason"))
    return Landed(frame, seen["n"] - seen["rejected"], rejects, seen["rejected"])


def _numbered_parquet(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ROW_INDEX: files in order of paths, and the place in the file; and their number."""
    placed = df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[2]))
    offsets = _offsets(placed.groupBy(PLACE[0]).agg(F.count(F.lit(1)).alias("records")), PLACE[:1])
    files, records = offsets.agg(F.count(F.lit(1)), F.sum("records")).first()
    return _join_offsets(placed, offsets.drop("records"), PLACE[:1], files), records or 0


def source_metadata(df: DataFrame, name: str, kind: str) -> DataFrame:
    """One row: source, kind, rows, columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("source_name"), F.lit(kind).alias("source_type"), "rows",
        F.lit(",".join(df.columns)).alias("columns"),
    )


# --- Fingerprints ------------------------------------------------------------

def content_fingerprint(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and fingerprint per file. A file beyond the binary reader's limit ends the job."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", content_fingerprint(F.col("content")).alias("fingerprint"))


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """One fingerprint of a file or a folder of parts: a single file's own, else that of the sorted ones."""
    each = file_fingerprints(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("one"),
        content_fingerprint(F.array_join(F.sort_array(F.collect_list("fingerprint")), "")).alias("all")).first()
    return each["one"] if each["n"] == 1 else each["all"]
