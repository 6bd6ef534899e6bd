"""Repeated passages: matching statistics of word windows on compressed FM-indexes.

Every window of a text has an anchor, the smallest hash among its short word
sequences; equal windows have the same anchor. A run of windows with the same
anchor is a stretch of text. Stretches whose anchor occurs once are done with; of
the others, each different one goes to the shard of its anchor, with the smallest
document that has it. A shard builds an FM-index over its stretches (words as
symbols, wavelet matrix of packed bits) and streams them through it from right to
left: backward search takes one more word in front, and once a match is as long
as a window, it is reported and loses its last word. The smallest document among
the matches of a window goes back to every occurrence of the stretch. Stretches
are named by two 64-bit hashes, of their anchor and their words; words themselves
are compared as text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, filter_table, in_filter, left_join_few, named, released, set_in, slices, with_row_key
from .queries import ORACLES, QUERIES, table

# Parameters: words of a window and of an anchor; windows of the longest stretch; stretches per shard;
# different stretches with one anchor beyond which they are dealt out window by window; bytes of text handled at once.
WINDOW = 13
GRAM = 5
LONGEST = 32
SHARD = 12_000
HOT = 25_000
CHUNK = 2 << 20
# Odd multipliers of the hash of a word sequence.
STEP, LAST = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # ASCII white space only


def _stretches(texts: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, first word, number of windows and anchor of the stretches of all texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    if total < window:
        return (np.zeros(0, np.int64),) * 4
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, total)
    text = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    grams = np.zeros(total - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(STEP) + hashes[i:total - gram + 1 + i]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(LAST)
    grams ^= grams >> np.uint64(29)
    # least of `window - gram + 1` neighbours, by doubling
    span, least = 1, grams
    wanted = window - gram + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:len(least) - span], least[span:])
        span *= 2
    if span < wanted:
        rest = wanted - span
        least = np.minimum(least[:len(least) - rest], least[rest:])
    at = np.flatnonzero(text[:total - window + 1] == text[window - 1:])
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    anchors = least[at].view(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    place = np.arange(len(at))
    run = np.maximum.accumulate(np.where(new, place, 0))
    starts = np.flatnonzero((place - run) % LONGEST == 0)
    windows = np.diff(starts, append=len(at))
    which = text[at[starts]]
    return which, at[starts] - first[which], windows, anchors[starts]


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                words = [words_of(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(_stretches(words, window, gram)[3])], ["anchor"])

    return run


def _shared_stretches(window: int, gram: int, shared, hot=None, wanted=None):
    """Stretches with shared anchors: key columns, anchor, hash and first word; of the wanted: anchor, hash, words.

    Those with hot anchors are dealt out window by window, each with its own hash as anchor.
    """
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                words = [words_of(t) for t in some.column("text").to_pylist()]
                which, start, windows, anchor = _stretches(words, window, gram)
                keep = set_in(shared.value, anchor)
                which, start, windows, anchor = (x[keep] for x in (which, start, windows, anchor))
                dealt = np.zeros(len(which), bool)
                if hot is not None:
                    dealt = set_in(hot.value, anchor)
                    times = np.where(dealt, windows, 1)
                    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    which, start, windows, anchor, dealt = (
                        np.repeat(x, times) for x in (which, start, windows, anchor, dealt))
                    start, windows = start + offset, np.where(dealt, 1, windows)
                body = [b" ".join(words[w][i:i + n + window - 1]) for w, i, n in zip(which, start, windows)]
                own = np.fromiter(map(xxhash.xxh3_64_intdigest, body), np.uint64, len(body)).view(np.int64)
                anchor = np.where(dealt, own, anchor)
                out = {"anchor": pa.array(anchor), "stretch": pa.array(own)}
                ids = some.select([*KEY, "doc_id"]).take(pa.array(which))
                if wanted is None:
                    out = dict(zip(ids.schema.names, ids.columns)) | out | {"start": pa.array(start, pa.int32())}
                else:
                    out["words"] = pa.array(body, pa.binary()).cast(pa.string())
                rows = pa.RecordBatch.from_pydict(out)
                if wanted is not None:
                    name = ids.column("doc_id").to_numpy() ^ anchor ^ (own << 1)
                    rows = rows.filter(pa.array(set_in(wanted.value, name)))
                yield rows

    return run


class BitVector:
    """Packed bits with counts per 64, for ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below).astype(np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class FMIndex:
    """An FM-index of a text of symbols from 0 on, for matches of up to `depth` symbols.

    Suffixes are sorted by their first `depth` symbols, which is all that backward
    search over so many steps needs. `places` are the suffixes in order; `group`
    numbers those with the same first `depth` symbols; `shorter` has the interval
    of those with the same first `depth` - 1.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        text = text.astype(np.int64)
        width = max(1, int(text.max()).bit_length())
        behind = lambda values, by: np.concatenate([values[by:], np.zeros(min(by, n), np.int64)])[:n]
        # ranks by as many symbols as fit a number, then by twice as many each time
        span = min(63 // width, depth - 1)
        keys = text
        for i in range(1, span):
            keys = keys << width | behind(text, i)
        rank = _ranks(keys)
        while span < depth - 1:
            by = min(span, depth - 1 - span)
            rank = _ranks(rank * (int(rank.max()) + 2) + behind(rank + 1, by))
            span += by
        whole = rank << width | behind(text, depth - 1)
        self.places = np.argsort(whole, kind="stable")
        whole, rank = whole[self.places], rank[self.places]
        self.group = np.cumsum(np.concatenate([[False], whole[1:] != whole[:-1]]))
        starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        sizes = np.diff(starts, append=n)
        self.shorter = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

        last = text[self.places - 1]
        self.levels = width
        self.bits, self.zeros = [], []
        symbols = np.arange(int(text.max()) + 1)
        base = np.zeros(len(symbols), np.int64)  # where a symbol's block starts after all levels
        for level in range(width - 1, -1, -1):
            bit = ((last >> level) & 1).astype(np.uint8)
            vector, zeros = BitVector(bit), int(n - bit.sum())
            self.bits.append(vector)
            self.zeros.append(zeros)
            last = np.concatenate([last[bit == 0], last[bit == 1]])
            ones = vector.rank(base)
            base = np.where((symbols >> level) & 1 == 1, zeros + ones, base - ones)
        self.first = np.cumsum(np.bincount(text, minlength=len(symbols))) - np.bincount(text, minlength=len(symbols))
        self.shift = self.first - base

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the sequences with one more symbol in front."""
        n = len(symbols)
        ends = np.concatenate([low, high])
        symbols = np.concatenate([symbols, symbols])
        for level, vector, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros):
            ones = vector.rank(ends)
            ends = np.where((symbols >> level) & 1 == 1, zeros + ones, ends - ones)
        ends += self.shift[symbols]
        return ends[:n], ends[n:]


def window_groups(text: np.ndarray, ends: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, FMIndex]:
    """For each window of each stretch of `text`, in order, the group of its matches in the index.

    Stretches of at least a window's length end before the places `ends`. All are
    streamed at once, from right to left, the longest first.
    """
    index = FMIndex(text, window)
    order = np.argsort(-lengths, kind="stable")
    right, long = ends[order], lengths[order]
    windows = lengths - window + 1
    base = (np.cumsum(windows) - windows)[order]
    groups = np.zeros(windows.sum(), np.int64)
    low, high = np.zeros(len(order), np.int64), np.full(len(order), len(text), np.int64)
    for step in range(int(long[0]) if len(long) else 0):
        active = int(np.searchsorted(-long, -step, side="left"))  # stretches longer than `step`
        low, high = low[:active], high[:active]
        if step >= window:  # a whole window matches: its last word goes
            low, high = index.shorter[0][low], index.shorter[1][low]
        low, high = index.extend(text[right[:active] - 1 - step], low, high)
        if step >= window - 1:
            groups[base[:active] + long[:active] - 1 - step] = index.group[low]
    return groups, index


def _match(window: int):
    columns = ["anchor", "stretch", "mins"]

    def match(texts: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        """Of one shard: per stretch the smallest document that has each of its windows."""
        rows = texts.drop_duplicates(["anchor", "stretch"]).merge(facts, on=["anchor", "stretch"])
        if rows.empty:
            return pd.DataFrame(columns=columns)
        split = [w.split(" ") for w in rows["words"]]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        numbers: dict[str, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(split)), np.int64)
        ends = np.cumsum(lengths + 1)
        text = np.zeros(ends[-1], np.int64)  # 0 ends each stretch
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        text[inside] = codes + 1
        groups, index = window_groups(text, ends - 1, lengths, window)
        least, most = rows["least"].to_numpy(np.int64), rows["most"].to_numpy(np.int64)
        document = least[np.repeat(np.arange(len(split)), lengths + 1)[index.places]]
        first = np.flatnonzero(np.concatenate([[True], index.group[1:] != index.group[:-1]]))
        found = np.minimum.reduceat(document, first)[groups]
        stops = np.cumsum(lengths - window + 1)
        starts = stops - (lengths - window + 1)
        keep = np.flatnonzero(np.minimum.reduceat(found, starts) < most)
        mins = [found[i:j] for i, j in zip(starts[keep], stops[keep])]
        return pd.DataFrame({
            "anchor": rows["anchor"].iloc[keep], "stretch": rows["stretch"].iloc[keep],
            "mins": pd.Series(mins, index=rows.index[keep], dtype=object)}, columns=columns)

    return match


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """KEY and `starts` (sorted): first words of windows that a row with a smaller doc_id has as well.

    `rows` has KEY, doc_id (long) and text; only rows with such windows are in the result.
    """
    spark = rows.sparkSession
    share = lambda keys: spark.sparkContext.broadcast(filter_table(keys, keys.count()))
    known = rows.filter("doc_id is not null")
    shared = share(stage(
        known.select("text").mapInArrow(released(_anchors(window, gram)), "anchor long")
        .groupBy("anchor").count().filter("count > 1").select("anchor"), "shared-anchors"))
    schema = f"{KEY[0]} long, {KEY[1]} long, doc_id long, anchor long, stretch long, start int"

    def found(hot):
        """All occurrences of stretches, and one row for each different one."""
        occurrences = stage(known.mapInArrow(released(_shared_stretches(window, gram, shared, hot)), schema), "occurrences")
        return occurrences, stage(occurrences.groupBy("anchor", "stretch").agg(
            F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "stretches")

    hot = None
    occurrences, different = found(hot)
    crowded = stage(different.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"), "hot-anchors")
    if not crowded.isEmpty():
        hot = share(crowded)
        occurrences, different = found(hot)

    # The words of a stretch come from its smallest document; a bounded filter spares the others the way.
    name = F.col("least").bitwiseXOR(F.col("anchor")).bitwiseXOR(F.shiftleft("stretch", 1))
    wanted = share(different.select(name.alias("name")))
    texts = known.mapInArrow(
        released(_shared_stretches(window, gram, shared, hot, wanted)), "anchor long, stretch long, words string")
    shards = max(1, -(-different.count() // SHARD))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    matches = stage(
        texts.groupBy(shard).cogroup(different.groupBy(shard))
        .applyInPandas(_match(window), "anchor long, stretch long, mins array<long>"), "matches")

    hit = stage(matches.select(F.xxhash64("anchor", "stretch").alias("key")), "hits")
    may_hit = in_filter(hit, hit.count())
    starts = F.filter(
        F.transform("mins", lambda least, i: F.when(least < F.col("doc_id"), F.col("start") + i)),
        lambda x: x.isNotNull())
    return (
        occurrences.filter(may_hit(F.xxhash64("anchor", "stretch"))).join(matches, ["anchor", "stretch"])
        .select(*KEY, starts.alias("starts")).filter(F.size("starts") > 0)
        .groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))
    )


def _without_windows(text: str | None, starts: list[int] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, how many the windows cover, and the others."""
    words = words_of(text)
    if not starts:
        return len(words), 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.array(starts) + window, -1)
    stay = np.cumsum(edges[:-1]) == 0
    return len(words), len(words) - int(stay.sum()), b" ".join(w for w, s in zip(words, stay) if s)


def _remove(window: int):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                found = [_without_windows(t, s, window) for t, s in zip(
                    some.column("text").to_pylist(), some.column("starts").to_pylist())]
                ids = some.select([*KEY, "doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [*ids.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in range(2)),
                     pa.array([f[2] for f in found], pa.binary()).cast(pa.string())],
                    [*ids.schema.names, "n_words", "n_removed", "kept"])

    return run


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: KEY, doc_id, n_words, n_removed and kept (words joined by blanks).

    A word goes if a window that covers it also starts in a row with a smaller
    id (long); windows are judged on the input. Rows with the same id don't count
    against each other; rows with a null id lose nothing and cost nothing. Null
    texts have no words, texts shorter than a window no windows. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = with_row_key(docs).select(
        *KEY, named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    starts = stage(repeated_windows(rows, window, gram), "repeated")
    return left_join_few(rows, starts).mapInArrow(
        released(_remove(window)),
        f"{KEY[0]} long, {KEY[1]} long, doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op10_substring_dedup"] = op10_substring_dedup
ORACLES["op10_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs)),
ranked AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY body) AS least FROM windows),
covered AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM ranked, (SELECT unnest(range(0, 13)) AS i) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
kept AS (
  SELECT p.doc_id, count(c.pos) AS n_removed,
         string_agg(p.word, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL) AS body
  FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(d.words)::bigint AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
