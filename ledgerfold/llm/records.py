"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record file is a sequence of frames. A frame is the payload's length (8 bytes),
the masked checksum of these 8 bytes (4), the payload, the masked checksum of the
payload (4), and a line feed; numbers are little-endian. The checksum is CRC-32,
rotated right by 15 bits plus a constant, so that a checksum over data that hold
checksums stays meaningful. A payload is the document's id (1 byte: whether it is
null; 8 bytes) and its token ids, 2 bytes each if all ids of the vocabulary fit,
else 4 (the first byte's second bit).

Files are written by Spark's writer, so a lost executor leaves no half file. The
index names file, offset and length of every record: a reader can fetch records
in any order without a scan.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import new_path, stage
from .bpe import Encoder, vocabulary_path
from .common import KEY, named, released, slices, with_row_key
from .queries import QUERIES, table

END_ID = 2
# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
NULL_ID, WIDE_IDS = 1, 2
HEAD, FOOT, DOCUMENT = "<QI", "<I", "<Bq"
HEAD_SIZE, FOOT_SIZE, DOCUMENT_SIZE = map(struct.calcsize, (HEAD, FOOT, DOCUMENT))
CLOSE = b"\n"
# Parameters: documents are dealt to about so many bytes of text per file; bytes of text handled at once; pieces of
# text that a worker knows.
FILE_BYTES = 32 * 1024 * 1024
CHUNK = 1_000_000
CACHED_PIECES = 400_000
# Fixed value: code points of a text that order rows with the same id.
TIE_CHARS = 32
# The order of records: rows that repeat are told apart by their place in the input.
ORDER = ["doc_id", "text_head", "text_hash", *KEY]


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record without its closing line feed, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FOOT, masked_crc(length)) + payload + struct.pack(FOOT, masked_crc(payload))


def payload_of(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE_IDS if wide else 0)
    return struct.pack(DOCUMENT, flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(DOCUMENT, payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE_IDS else "<u2", offset=DOCUMENT_SIZE)
    return None if flags & NULL_ID else doc_id, ids


def frames(data: bytes):
    """(offset, length, payload) of each record of a file; a damaged one is an error."""
    at = 0
    while at < len(data):
        length, crc = struct.unpack_from(HEAD, data, at)
        end = at + HEAD_SIZE + length
        if crc != masked_crc(data[at:at + 8]) or end + FOOT_SIZE >= len(data):
            raise ValueError(f"damaged record length at {at}")
        payload = data[at + HEAD_SIZE:end]
        if struct.unpack_from(FOOT, data, end)[0] != masked_crc(payload) or data[end + FOOT_SIZE:end + FOOT_SIZE + 1] != CLOSE:
            raise ValueError(f"damaged record at {at}")
        yield at, length, payload
        at = end + FOOT_SIZE + 1


def _records(path: str, end_id: int, kept, bounds):
    """Records of the texts with their file, `bounds` being the least keys of all files but the first.

    A worker process keeps its encoder, with up to CACHED_PIECES known pieces
    (about 100 MB), for the tasks of this table that follow: what is broadcast is
    an empty dictionary, which each process fills for itself and drops with it.
    """
    def run(batches):
        if path not in kept.value:
            kept.value[path] = Encoder(path, CACHED_PIECES, CHUNK)
        encoder = kept.value[path]
        wide = max(len(encoder.sizes), end_id + 1) > 1 << 16
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                keys = [_key(*values) for values in zip(*(some.column(c).to_pylist() for c in ORDER))]
                out = [
                    frame(payload_of(doc_id, np.concatenate([ids, end]), wide)) for doc_id, ids in zip(
                        some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bisect_right(bounds.value, k) for k in keys], pa.int32()),
                     *(some.column(c) for c in ORDER), pa.array(out, pa.binary())], ["file", *ORDER, "record"])

    return run


def _key(doc_id: int | None, head: str | None, *numbers: int) -> tuple:
    """A key of ORDER as Python orders it: nulls first, texts by their bytes."""
    return doc_id is not None, doc_id or 0, head is not None, (head or "").encode("utf-8", "surrogatepass"), *numbers


def write_records(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, files: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of all texts of `docs`, each with `end_id` behind, to new files in `folder`.

    File after file, and within each, documents are in ascending order of a long
    id, null first; rows with the same id are in order of their text's first
    TIE_CHARS code points, then of a hash of it, and may be in several files. A
    null text is empty: its record holds the end id alone. An empty table gives a
    folder without records. Other columns are ignored. Texts are encoded whole,
    where they are read: the least key of each file is found first, from the keys
    alone, so that a record goes straight to its file.
    """
    spark = docs.sparkSession
    rows = with_row_key(docs).select(
        named(id_col).cast("long").alias("doc_id"), F.substring(named(text_col), 1, TIE_CHARS).alias("text_head"),
        F.xxhash64(named(text_col)).alias("text_hash"), *KEY, F.coalesce(named(text_col), F.lit("")).alias("text"))
    keys = stage(rows.select(*ORDER, F.octet_length("text").alias("bytes")), "record-keys")
    if files is None:
        files = max(1, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES))
    least = (
        keys.repartitionByRange(files, *ORDER).groupBy(F.spark_partition_id().alias("file"))
        .agg(F.min(F.struct(*ORDER)).alias("least"))
    )
    bounds = sorted(_key(*r["least"]) for r in least.collect())[1:]  # one per file
    context = spark.sparkContext
    records = rows.mapInArrow(
        released(_records(path, end_id, context.broadcast({}), context.broadcast(bounds))),
        f"file int, doc_id long, text_head string, text_hash long, {KEY[0]} long, {KEY[1]} long, record binary")
    ordered = records.repartitionById(len(bounds) + 1, "file").sortWithinPartitions(*ORDER)
    # the text writer puts out the bytes of a string as they are, and one line feed after each
    ordered.select(F.col("record").cast("string")).write.option("lineSep", "\n").text(folder)


def _index(batches):
    for batch in batches:
        for name, data in zip(batch["path"], batch["content"]):
            start, out, held = 0, [], 0
            for offset, length, payload in frames(data):
                doc_id, ids = read_payload(payload)
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                out.append((name, offset, length, doc_id, start, len(ids), crc))
                start += len(ids)
                held += 1
                if held % 10_000 == 0:
                    yield _index_frame(out)
                    out = []
            yield _index_frame(out)


def _index_frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["file", "offset", "length", "doc_id", "start_in_file", "n_tokens", "ids_crc32"]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def write_index(spark: SparkSession, folder: str, index_folder: str) -> DataFrame:
    """Read and check all records of `folder`; write and return their index.

    Columns: file, offset, length (of the payload), doc_id, start (token ids in
    all records before, over the files in order), n_tokens, ids_crc32.
    """
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    entries = stage(content.select("path", "content").mapInPandas(
        released(_index), "file string, offset long, length long, doc_id long, start_in_file long, n_tokens long, "
                "ids_crc32 long"), "entries")
    files = entries.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    index = entries.join(bases, "file").select(
        "file", "offset", "length", "doc_id", (F.col("base") + F.col("start_in_file")).alias("start"),
        "n_tokens", "ids_crc32")
    index.write.parquet(index_folder)
    return spark.read.parquet(index_folder)


def read_shuffled(spark: SparkSession, index: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id and ids of all records of an index, in an order that the seed alone decides.

    The index is shuffled by hashes of (seed, file, offset); records are cut out
    of their files by offset and length.
    """
    def cut(batches):
        for batch in batches:
            out = []
            for content, offset, length in zip(batch["content"], batch["offsets"], batch["lengths"]):
                for at, size in zip(offset, length):
                    out.append((int(at), *read_payload(content[at + HEAD_SIZE:at + HEAD_SIZE + size])))
            for i in range(0, len(out), 10_000):
                yield pd.DataFrame(
                    [(at, doc, ids.astype("int64")) for at, doc, ids in out[i:i + 10_000]],
                    columns=["offset", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    wanted = index.groupBy("file").agg(
        F.collect_list("offset").alias("offsets"), F.collect_list("length").alias("lengths"))
    folder = [r[0] for r in index.select(F.regexp_replace("file", "/[^/]*$", "")).distinct().collect()]
    if not folder:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    found = content.join(wanted, content["path"] == wanted["file"]).select("content", "offsets", "lengths").mapInPandas(
        cut, "offset long, doc_id long, ids array<long>")
    return found.orderBy(F.xxhash64(F.lit(seed), "doc_id", "offset")).select("doc_id", "ids")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    index = write_index(spark, folder, new_path(spark, "record-index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES["op4_token_records"] = op4_token_records
