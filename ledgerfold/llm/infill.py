"""Fill-in-middle: cut each text at two token boundaries and move its middle to the end.

The boundaries of a text, the ends of its tokens in code points, are kept as a
set of the kind roaring bitmaps are: a container per 65,536 code points, which is
an array of offsets, a bitmap or a list of runs, whichever is smallest, and the
cumulative cardinalities of the containers. The offset after m tokens is the m-th
boundary: a search of the cardinalities finds the container, a select inside it
the offset.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices
from .queries import ORACLES, QUERIES, table

# Fixed values of the query: what the hash begins with, percent of texts that are moved, and of these in the second
# form; the signs before prefix, suffix and middle.
SEED = 1
MOVED_PERCENT = 90
SPM_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Fixed values of the set: code points per container, and bytes of an array's entry, of a run and of a bitmap.
SPAN = 1 << 16
ENTRY_BYTES, RUN_BYTES, BITMAP_BYTES = 2, 4, SPAN // 8
# Parameter: bytes of text handled at once.
CHUNK = 1_000_000


@dataclass
class Array:
    offsets: np.ndarray  # uint16

    def select(self, place: int) -> int:
        return int(self.offsets[place])


@dataclass
class Runs:
    starts: np.ndarray  # uint16
    before: np.ndarray  # members in the runs before each

    def select(self, place: int) -> int:
        run = int(np.searchsorted(self.before, place, "right")) - 1
        return int(self.starts[run]) + place - int(self.before[run])


@dataclass
class Bitmap:
    words: np.ndarray  # uint64
    before: np.ndarray  # members in the words before each

    def select(self, place: int) -> int:
        word = int(np.searchsorted(self.before, place, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(bits[place - int(self.before[word])])


def container(member: np.ndarray) -> Array | Runs | Bitmap:
    """The smallest container for the members of one span, given as up to SPAN booleans."""
    edges = np.flatnonzero(np.diff(member, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    count = int((ends - starts).sum())
    if RUN_BYTES * len(starts) < min(ENTRY_BYTES * count, BITMAP_BYTES):
        return Runs(starts.astype(np.uint16), np.cumsum(ends - starts) - (ends - starts))
    if ENTRY_BYTES * count <= BITMAP_BYTES:
        return Array(np.flatnonzero(member).astype(np.uint16))
    words = np.packbits(np.pad(member, (0, SPAN - len(member))), bitorder="little").view("<u8")
    counts = np.bitwise_count(words).astype(np.int64)
    return Bitmap(words, np.cumsum(counts) - counts)


class BoundarySet:
    """A set of offsets from 1 on, `member[i]` telling whether i + 1 is in it."""

    def __init__(self, member: np.ndarray):
        parts = [member[i:i + SPAN] for i in range(0, len(member), SPAN)]
        self.containers = [container(p) for p in parts]
        self.cardinalities = np.cumsum([np.count_nonzero(p) for p in parts], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cardinalities[-1]) if len(self.cardinalities) else 0

    def after(self, units: int) -> int:
        """The offset at which the first `units` units end."""
        if not units:
            return 0
        at = int(np.searchsorted(self.cardinalities, units))
        before = int(self.cardinalities[at - 1]) if at else 0
        return at * SPAN + self.containers[at].select(units - 1 - before) + 1


def boundaries(text: str) -> BoundarySet:
    """Ends of the tokens of a text: runs of A-Z and a-z, and every other code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = codes | 32
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    inside = letter.copy()
    inside[:-1] &= letter[1:]
    if len(inside):
        inside[-1] = False
    return BoundarySet(~inside)


def _cut(text: str, hashes: list[int], moved_percent: int, spm_percent: int):
    """n, form, code points of prefix and of middle, output."""
    ends = boundaries(text)
    n = len(ends)
    if not text or any(sign in text for sign in (PREFIX, SUFFIX, MIDDLE)) or hashes[2] % 100 >= moved_percent:
        return n, "plain", None, None, text
    first, second = (ends.after(m) for m in sorted(h % (n + 1) for h in hashes[:2]))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if hashes[3] % 100 < spm_percent:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(seed: int, moved_percent: int, spm_percent: int):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                out = []
                for name, text in zip(some.column("doc_name").to_pylist(), some.column("text")):
                    digest = sha256(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()
                    hashes = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
                    out.append(_cut(text.as_py(), hashes, moved_percent, spm_percent))
                columns = [pa.array(values, kind) for values, kind in zip(list(zip(*out)), kinds)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], ["doc_id", *names])

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, moved_percent: int = MOVED_PERCENT, spm_percent: int = SPM_PERCENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n, form, prefix_chars, middle_chars and output.

    n is the number of tokens, [A-Za-z]+|[^A-Za-z] from left to right; the cuts
    and the form come from the first four 8-digit groups of the hex sha256 of
    "<seed>:<doc_id>", a null id counting as empty text. The output is the text
    (form plain), <P>prefix<S>suffix<M>middle (psm) or <S>suffix<P>prefix<M>middle
    (spm); lengths are in code points and null for plain texts. Empty texts, and
    those that hold one of the signs, are plain. A null text is empty. Rows with
    the same id and text come out alike. An empty table gives no rows. Other
    columns are ignored. A text is handled whole, whatever its length, in the
    scan; nothing is shuffled.
    """
    rows = docs.select(
        named(id_col).alias("doc_id"), F.coalesce(named(id_col).cast("string"), F.lit("")).alias("doc_name"),
        F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _transform(seed, moved_percent, spm_percent),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of.

    A text with a sign in it is plain, so the first place of each sign is the one that was put there.
    """
    def between(head: str, tail: str | None) -> Column:
        start = F.instr(output, head) + len(head)
        end = F.instr(output, tail) if tail else F.length(output) + 1
        return F.substring(output, start, end - start)

    joined = lambda *parts: reduce(F.concat, parts)
    return (
        F.when(form == "psm", joined(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)))
        .when(form == "spm", joined(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX)))
        .otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES["op12_fill_in_middle"] = op12_fill_in_middle
ORACLES["op12_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) AS hash,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
h AS (
  SELECT *, len(units) AS n, ('0x' || hash[1:8])::bigint AS h1, ('0x' || hash[9:16])::bigint AS h2,
         ('0x' || hash[17:24])::bigint AS h3, ('0x' || hash[25:32])::bigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
parts AS (
  SELECT doc_id, n, text, h3, h4, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                      OR h3 % 100 >= {MOVED_PERCENT} THEN 'plain'
                 WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM parts)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""
