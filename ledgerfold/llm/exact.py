"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each input partition sends the sorted distinct 64-bit fingerprints of its texts,
as Golomb-Rice coded gaps, to the owners of the fingerprint ranges. An owner
returns each message with a bitmap of the fingerprints that occur elsewhere or
more than once. Only rows behind a set bit are suspects; only their texts move,
and they are grouped by their bytes. The fingerprint alone decides nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, ascii_lower, named, rows_in, with_row_key
from .queries import ORACLES, QUERIES, table

FINGERPRINTS_PER_OWNER = 500_000
MESSAGE = "owner int, part int, n int, base string, shift int, unary binary, rest binary, many binary"


def golomb_encode(values: np.ndarray, base: int, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 `values` from `base` on: Rice shift, quotients in unary, remainders."""
    gaps = np.diff(values, prepend=np.uint64(base))
    shift = max(0, (span // len(values)).bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1)
    unary = np.zeros(ends[-1], np.uint8)
    unary[ends - 1] = 1
    places = np.arange(shift, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return shift, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_decode(n: int, base: int, shift: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * shift).reshape(n, shift)
    for place in range(shift):
        gaps |= bits[:, place].astype(np.uint64) << np.uint64(place)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _messages(owners: int):
    """One message per part and owner from the fingerprints that a task reads."""
    span = -(-(1 << 64) // owners)

    def send(batches):
        parts = defaultdict(list)
        for batch in batches:
            for part, values in batch.groupby("part")["fingerprint"]:
                parts[part].append(values.to_numpy(np.int64).view(np.uint64))
        for part, arrays in parts.items():
            values, counts = np.unique(np.concatenate(arrays), return_counts=True)
            owner = (values // np.uint64(span)).astype(np.int64)
            out = []
            for mine in np.unique(owner):
                at = slice(*np.searchsorted(owner, [mine, mine + 1]))
                base = int(mine) * span
                shift, unary, rest = golomb_encode(values[at], base, span)
                n = at.stop - at.start
                out.append((mine, part, n, str(base), shift, unary, rest, _bits(counts[at] > 1)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in MESSAGE.split(", ")])

    return send


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """The messages of one owner, with a bit set for each fingerprint found twice."""
    lists = [golomb_decode(int(m.n), int(m.base), int(m["shift"]), m.unary, m.rest) for _, m in messages.iterrows()]
    many = [_flags(m.many, m.n) for _, m in messages.iterrows()]
    values, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = np.concatenate(many) | (counts[place] > 1)
    ends = np.cumsum([len(x) for x in lists])
    return messages.assign(many=[_bits(x) for x in np.split(twice, ends[:-1])])


def _suspect(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The rows of one part, marked where a reply has their fingerprint as a duplicate."""
    found = [
        golomb_decode(int(m.n), int(m.base), int(m["shift"]), m.unary, m.rest)[_flags(m.many, m.n)]
        for _, m in replies.iterrows()
    ]
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    own = rows["fingerprint"].to_numpy(np.int64).view(np.uint64)
    return rows.drop(columns=["part", "fingerprint"]).assign(suspect=np.isin(own, values))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per row of `docs`: its group of equal texts and whether it stays.

    Columns: KEY, doc_id, keep_id, group_size, kept, text_sha256. Texts are equal
    if they are after lower-casing A-Z; null counts as empty, and empty texts are
    equal. The row with the largest id stays; a null id is smallest; of several
    rows with that id, the first in the stored input stays. An empty table gives
    no rows. Other columns are ignored. With `keyed`, `docs` has KEY already.
    Only suspects' texts move, whole, whatever their length.
    """
    source = docs if keyed else with_row_key(docs)
    text = ascii_lower(F.coalesce(named(text_col), F.lit("")))
    rows = stage(source.select(
        *KEY, named(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("fingerprint"), F.spark_partition_id().alias("part"),
    ), "fingerprints")
    owners = max(2, -(-rows.count() // FINGERPRINTS_PER_OWNER))
    messages = rows.select("part", "fingerprint").mapInPandas(_messages(owners), MESSAGE)
    replies = messages.groupBy("owner").applyInPandas(_answer, MESSAGE)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-2])
    marked = stage(
        rows.groupBy("part").cogroup(replies.groupBy("part"))
        .applyInPandas(_suspect, f"{schema}, suspect boolean"), "suspects")

    suspects = marked.filter("suspect").drop("suspect")
    moved = rows_in(source.select(*KEY, text.alias("bytes")), suspects)
    groups = stage(
        moved.groupBy("text_sha256", "bytes")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .drop("bytes"), "groups")
    grouped = suspects.join(groups, "text_sha256")
    stays = (
        grouped.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("text_sha256").agg(F.min(F.struct(*KEY)).alias("first"))
        .select("first.*", F.lit(True).alias("stays"))
    )
    columns = [*KEY, "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = marked.filter("not suspect").select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    shared = grouped.join(stays, KEY, "left").withColumn("kept", F.coalesce("stays", F.lit(False)))
    return single.select(columns).unionByName(shared.select(columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(*KEY)


QUERIES["op6_exact_dedup"] = op6_exact_dedup
ORACLES["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
