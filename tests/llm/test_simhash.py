from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerfold.llm.graph import components
from ledgerfold.llm.simhash import _chain_keys, _emit_keys, _forest, dealt, links_between, near_duplicates, parts


def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(rows, distance=3):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if label[j] < label[i] and (a ^ b).bit_count() <= distance:
                    label[i], changed = label[j], True
    least = {}
    for (doc_id, _), x in zip(rows, label):
        known = [i for i in (doc_id, least.get(x)) if i is not None]
        least[x] = min(known, default=None)
    return [(d, p, least[x]) for (d, _), p, x in zip(rows, prints, label)]


def check(docs, rows):
    found = near_duplicates(docs).collect()
    got = sorted((str(r["doc_id"]), r["fingerprint"] & (1 << 64) - 1, str(r["component_id"])) for r in found)
    want = brute_components(rows)
    assert got == sorted((str(d), p, str(c)) for d, p, c in want)
    groups = len({r["component_id"] if r["component_id"] is not None else r["fingerprint"] for r in found})
    assert sum(r["first"] for r in found) == groups


def test_documents_like_brute_force(spark, sf_dir, documents):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), [(d, t) for d, t, _ in documents])


def test_awkward_rows_like_brute_force(edge_docs, edge_rows):
    check(edge_docs, [(d, t) for d, t, *_ in edge_rows])


def test_empty_table(empty_docs):
    assert near_duplicates(empty_docs).count() == 0


def test_near_prints_share_a_key_and_pass_the_chain():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b ^= 1 << int(bit)
        pair = np.array([a, b], np.uint64)
        hits = [s for s in range(4) for keys in _chain_keys(pair, s)
                if keys[0] == keys[1] and _forest(pair.view(np.int64), s, 3)]
        assert hits


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500}


def test_parts_are_all_bits_once():
    for bits in (0, 1, 0b1011, (1 << 64) - 1, 0x8000000000000001, 0xF0F0F0F0F0F0F0F0):
        masks = parts(bits, 4)
        assert sum(masks) == bits and all(a & b == 0 for a, b in combinations(masks, 2))
        assert max(m.bit_count() for m in masks) - min(m.bit_count() for m in masks) <= 1


@pytest.mark.parametrize("largest", [40, 500])
def test_large_keys_are_dealt_out(spark, largest):
    """Prints that differ in few bits, so that all have one key: the same components, in groups of bounded size."""
    rng = np.random.default_rng(11)
    places = rng.choice(64, 18, replace=False)
    values = rng.choice(1 << 18, 3000, replace=False)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ sum(((int(v) >> k) & 1) << int(p) for k, p in enumerate(places)) for v in values})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(4)
    keys = dealt(frame.mapInPandas(_emit_keys, "start int, key long, fingerprint long"), 3, largest)
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= largest
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 3):
            root[find(i + 1 + int(j))] = find(i)
    place = {x: i for i, x in enumerate(signed)}
    own = list(range(len(signed)))

    def find_own(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for r in links_between(frame, 3, largest).collect():
        a, b = place[r["a"]], place[r["b"]]
        assert find(a) == find(b)
        own[find_own(a)] = find_own(b)
    assert len({find_own(i) for i in own}) == len({find(i) for i in root})
