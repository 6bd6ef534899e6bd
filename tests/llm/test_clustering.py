import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.errors import PySparkException

from ledgerfold.llm.clustering import assign, cluster, drifted, geometry, op11_centroid_clusters, squared

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int, distance string"


def brute(rows, k, rounds, dimensions, scale, seed):
    """(vec_id, cluster, distance) of each kept row, and the centroids, by all distances in Python integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vector]))
    hashed = lambda i: sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    return sorted(((i, *nearest(q)[::-1]) for i, q in kept), key=str), centroids


def rows(rng, n, dimensions, step):
    """Vectors on a coarse grid, so that many distances tie; ids repeat, some are null, some vectors are no good."""
    out = [(int(i) % (n // 2) if i % 7 else None, [float(x) for x in rng.integers(-3, 4, dimensions) * step]) for i in range(n)]
    out += [out[0], out[1], out[1], (5, None), (6, []), (7, [1.0] * (dimensions - 1)), (8, [float("nan")] * dimensions)]
    return out + [(9, [None] + [0.5] * (dimensions - 1)), (10, [float("inf")] + [0.5] * (dimensions - 1))]


@pytest.mark.parametrize("k, rounds, n", [(1, 2, 30), (7, 5, 80), (40, 3, 60), (40, 2, 12), (3, 0, 20)])
def test_rows_and_centroids_equal_brute_force(spark, k, rounds, n):
    given = rows(np.random.default_rng(k), n, 4, 0.37)
    frame = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in given], SCHEMA).repartition(5)
    found, clusters = cluster(frame, k, rounds, dimensions=4, scale=16, seed=2)
    want, centroids = brute(given, k, rounds, 4, 16, 2)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == want
    assert [c["centroid"] for c in clusters] == centroids
    assert sum(c["size"] for c in clusters) == len(want)
    assert sum(c["inertia"] for c in clusters) == sum(r[2] for r in want)


def test_nothing_to_cluster(spark):
    for given in ([], [(1, None, "x", 1, "y"), (2, [1.0], "x", 1, "y")]):
        found, clusters = cluster(spark.createDataFrame(given, SCHEMA), dimensions=4)
        assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance"] and clusters == []


def test_distances_beyond_64_bits_are_an_error(spark):
    with pytest.raises(PySparkException, match="don't fit 64 bits"):
        cluster(spark.createDataFrame([(1, [1e30] * 4, "x", 1, "y")], SCHEMA), dimensions=4)
    edge = [(i, [float(2**20 * (-1) ** i)] * 4, "x", 1, "y") for i in range(4)]
    found, _ = cluster(spark.createDataFrame(edge, SCHEMA), k=2, rounds=1, dimensions=4, scale=256)
    assert {r["distance"] for r in found.collect()} <= {0, 4 * 2**58}


@pytest.mark.parametrize("seed", range(12))
def test_bounds_hold_over_many_rounds(seed):
    rng = np.random.default_rng(seed)
    k, dimensions, spread = int(rng.integers(2, 30)), int(rng.integers(1, 6)), int(rng.choice([2, 20, 10**6]))
    q = rng.integers(-spread, spread + 1, (300, dimensions))
    centroids = q[rng.choice(300, k)].copy()
    labels, second = np.zeros(300, np.int64), np.full(300, 1)
    upper, lower = np.full(300, np.inf), np.zeros(300)
    for _ in range(12):
        known = geometry(centroids)
        assign(q, labels, second, upper, lower, known)
        every = np.stack([squared(q, c) for c in centroids], axis=1)
        assert (labels == every.argmin(axis=1)).all()
        own = np.sqrt(every[np.arange(300), labels])
        every[np.arange(300), labels] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(every.min(axis=1))).all() and (second != labels).all()
        moved = centroids + rng.integers(-1 - spread // 30, 2 + spread // 30, centroids.shape)
        upper, lower = drifted(labels, upper, lower, np.sqrt(squared(moved, centroids)) * (1 + 1e-14))
        centroids = moved


def test_few_distances_are_measured_on_clustered_vectors(monkeypatch):
    import ledgerfold.llm.clustering as module

    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (40, 16))
    q = np.repeat(middles, 50, axis=0) + rng.integers(-200, 200, (2000, 16))
    measured = []
    monkeypatch.setattr(module, "squared", lambda a, b: (measured.append(len(a)), squared(a, b))[1])
    known = geometry(middles)
    labels, second = np.zeros(2000, np.int64), np.ones(2000, np.int64)
    upper, lower = np.full(2000, np.inf), np.zeros(2000)
    assign(q, labels, second, upper, lower, known)
    assert (labels == np.repeat(np.arange(40), 50)).all()
    measured.clear()
    upper, lower = drifted(labels, upper, lower, np.full(40, 2.0))
    assign(q, labels, second, upper, lower, known)
    assert sum(measured) < 2000  # of 80,000


def test_query_gives_every_kept_vector(spark, sf_dir):
    found = op11_centroid_clusters(spark, sf_dir)
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = brute(given, 40, 5, 64, 256, 2)
    got = found.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert {r["inertia"] for r in got} == {sum(r[2] for r in want)}
    assert all(r["centroid_sha256"] == sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in got)
