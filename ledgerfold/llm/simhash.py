"""SimHash fingerprints and their near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of four segments. If two fingerprints differ
in at most three bits, there is a start from which each chain of consecutive
segments stays within its share of the budget: no difference in the first
segment, at most one in two, two in three, three in four. Equal first segments
and an equal half of the second (one difference spares one half) are therefore
keys that every such pair shares; within a key the chains are tested, then the
whole distance.

A key with many fingerprints is dealt out: the bits in which these differ are
split into one part more than the distance, so near fingerprints agree in one of
them, and that part's bits are added to the key; again, until no key has many.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, give_back, named, released, with_row_key
from .graph import components
from .queries import QUERIES, table

# Words per shingle, most differing bits, seed of the hash.
SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
BLOCK = 2048
CHUNK = 1 << 16
# Parameter: fingerprints with one key beyond which they are dealt out.
LARGEST = 4096


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    columns = [words[i:] for i in range(min(shingle, len(words)))]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, set_bits, shingles = 0, np.zeros(64, np.int64), zip(*columns)
    while True:
        hashes = np.fromiter((digest(join(s), SEED) for s, _ in zip(shingles, range(CHUNK))), np.uint64)
        if not len(hashes):
            break
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprint(shingle: int = SHINGLE):
    """The fingerprint of a text column as a long; its bits are what counts."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:  # one text at a time is a Python object
        prints = pa.array((_fingerprint(t.as_py(), shingle) for t in texts), pa.int64(), size=len(texts))
        give_back()
        return prints

    return simhash


def _chain_keys(prints: np.ndarray, start: int) -> np.ndarray:
    """For both halves of the second segment: the keys of `prints` at a start."""
    ring = np.bitwise_or(prints >> np.uint64(start * WIDTH), prints << np.uint64(64 - start * WIDTH)) if start else prints
    first = ring & np.uint64((1 << WIDTH) - 1)
    second = (ring >> np.uint64(WIDTH)) & np.uint64((1 << WIDTH) - 1)
    half = np.uint64(WIDTH // 2)
    low = second & np.uint64((1 << (WIDTH // 2)) - 1)
    tags = np.uint64(start * 2) << np.uint64(32)
    return np.stack([tags | first << half | low, tags | np.uint64(1 << 32) | first << half | second >> half])


def _emit_keys(batches):
    for batch in batches:
        prints = batch["fingerprint"].to_numpy(np.int64).view(np.uint64)
        for start in range(SEGMENTS):
            for keys in _chain_keys(prints, start):
                yield pd.DataFrame({"start": start, "key": keys.view(np.int64), "fingerprint": prints.view(np.int64)})


def parts(bits: int, n: int) -> list[int]:
    """The set bits of a number dealt to n masks in turn."""
    places = [i for i in range(64) if bits >> i & 1]
    return [sum(1 << i for i in places[k::n]) for k in range(n)]


def _masks(n: int):
    def run(batches):
        for batch in batches:
            masks = [parts(int(v) & (1 << 64) - 1, n) for v in batch["differ"]]
            yield pd.DataFrame({"key": batch["key"], "masks": [np.array(m, np.uint64).view(np.int64) for m in masks]})

    return run


def dealt(keys: DataFrame, distance: int, largest: int = LARGEST) -> DataFrame:
    """`keys` (start, key, fingerprint) with keys of at most `largest` fingerprints, which near ones still share.

    Each round only the large keys' rows are keyed anew, once per part of the bits
    in which they differ. These get fewer each round, so rounds are few.
    """
    small, largest = [], max(largest, 2 << distance)  # so that a large key differs in a bit of each part
    while True:
        large = stage(
            keys.groupBy("key").agg(
                F.count("*").alias("n"), F.expr("bit_or(fingerprint) ^ bit_and(fingerprint)").alias("differ"))
            .filter(F.col("n") > largest).select("key", "differ")
            .mapInPandas(_masks(distance + 1), "key long, masks array<long>"), "large-keys")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*small, keys])
        small.append(keys.join(large, "key", "left_anti"))
        keys = stage(
            keys.join(large, "key").select("start", "key", "fingerprint", F.posexplode("masks").alias("part", "mask"))
            .select("start", F.xxhash64("key", "part", F.col("fingerprint").bitwiseAND(F.col("mask"))).alias("key"), "fingerprint"),
            "dealt-keys")


def _within(a: np.ndarray, b: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Which of the pairs a x b keep all chain budgets from `start` and the whole distance."""
    differ = (a[:, None] ^ b[None, :]).view(np.uint64)
    total = np.zeros(differ.shape, np.uint8)
    fits = np.ones(differ.shape, bool)
    for length in range(1, SEGMENTS + 1):
        at = np.uint64((start + length - 1) % SEGMENTS * WIDTH)
        total += np.bitwise_count((differ >> at) & np.uint64((1 << WIDTH) - 1))
        fits &= total <= length * distance // SEGMENTS
    return fits


def _forest(prints: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links that connect all of `prints` that near ones connect: at most one per fingerprint.

    Breadth-first from the smallest one left, so no pair is tested twice and none is stored.
    """
    links, left = [], np.sort(prints)
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(frontier), BLOCK):
                for j in range(0, len(left), BLOCK):
                    near[j:j + BLOCK] |= _within(frontier[i:i + BLOCK], left[j:j + BLOCK], start, distance).any(axis=0)
            frontier, left = left[near], left[~near]
            links += [(int(root), int(x)) for x in frontier]
    return links


def _link(distance: int):
    def groups(batches):
        """(start, fingerprints) of the keys in the sorted rows, also where a key runs over batches."""
        last, held = None, []
        for batch in batches:
            keys, starts = batch["key"].to_numpy(), batch["start"].to_numpy()
            prints = batch["fingerprint"].to_numpy(np.int64)
            cuts = np.flatnonzero(np.diff(keys) | np.diff(starts)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                if i < j and (keys[i], starts[i]) == last:
                    held.append(prints[i:j])
                elif i < j:
                    if held:
                        yield last[1], np.concatenate(held)
                    last, held = (keys[i], starts[i]), [prints[i:j]]
        if held:
            yield last[1], np.concatenate(held)

    def run(batches):
        links = []
        for start, prints in groups(batches):
            if len(prints) > 1:
                links += _forest(prints, int(start), distance)  # signed, as components() orders them
            if len(links) > CHUNK:
                yield _frame(links)
                links = []
        if links:
            yield _frame(links)

    def _frame(links):
        ends = np.array(links, np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def links_between(prints: DataFrame, distance: int = DISTANCE, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) that connect what near fingerprints connect, of the different ones in `prints` (fingerprint)."""
    keys = prints.select("fingerprint").mapInPandas(released(_emit_keys), "start int, key long, fingerprint long")
    return (
        dealt(keys, distance, largest).repartition("key").sortWithinPartitions("key", "start")
        .mapInPandas(released(_link(distance)), "a long, b long"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text",
    keyed: bool = False,
) -> DataFrame:
    """One row per row of `docs`: its fingerprint and the smallest id reachable over links.

    Columns: KEY, doc_id, fingerprint (long), component_id, first (whether this row
    stands for its component: the row with that id, and of several the first in
    the stored input). Words are split at ASCII white space, A-Z lower-cased;
    shingles are counted with repeats. Null and empty texts have fingerprint zero
    and are linked like any other. Null ids count only where a component has no
    other; its id is then null. An empty table gives no rows. Other columns are
    ignored. Distances up to 3 are possible.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys find distances up to {DISTANCE}")
    prints = stage((docs if keyed else with_row_key(docs)).select(
        *KEY, named(id_col).alias("doc_id"), fingerprint(shingle)(named(text_col)).alias("fingerprint")), "simhash")
    distinct = stage(
        prints.groupBy("fingerprint").agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("head")), "distinct-prints")
    links = stage(links_between(distinct, distance), "links")
    roots = components(links).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named_roots = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("head").alias("head"))
    classes = stage(
        rooted.select("fingerprint", "root").join(named_roots, "root")
        .select("fingerprint", "component_id", *(F.col(f"head.{k}").alias(f"head{k}") for k in KEY)), "classes")
    is_head = (F.col(KEY[0]) == F.col(f"head{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"head{KEY[1]}"))
    return prints.join(classes, "fingerprint").select(
        *KEY, "doc_id", "fingerprint", "component_id", is_head.alias("first"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op9_simhash"] = op9_simhash
