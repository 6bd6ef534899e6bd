"""Centroid clustering (Lloyd's rounds) in whole numbers, with shallot search.

Each vector keeps an upper bound of the distance to its centroid, a lower bound
of that to any other, and its second-nearest centroid. While the upper bound is
below the lower one, or below half the way to the next centroid, nothing is
measured. Otherwise the search starts from the closer of the two remembered
centroids and goes through that one's neighbours in order of their distance. It
ends where a neighbour is farther off than the distance to the start plus that
to the second-nearest found so far, a ball that shrinks with each find. What is
measured is compared in integers, so that ties are exact; the bounds are rounded
outwards.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import new_path, remove, stage
from .common import named
from .queries import ORACLES, QUERIES, table

# Fixed values of the query: components, parts of a unit, centroids, rounds, and what the start's hash begins with.
DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
# Fixed value: what bounds are rounded outwards by, more than two roundings.
SLACK = 1e-14
STATE = "vec_id {kind}, q array<int>, cluster int, second int, upper double, lower double"


@dataclass
class Geometry:
    centroids: np.ndarray  # k x components, int64
    near: np.ndarray  # k x (k - 1): the other centroids, nearest first
    gaps: np.ndarray  # their distances, rounded down
    half: np.ndarray  # half the distance to the nearest one, rounded down


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two int64 arrays."""
    differ = a - b
    return np.einsum("ij,ij->i", differ, differ)


def geometry(centroids: np.ndarray) -> Geometry:
    k = len(centroids)
    near, gaps = np.zeros((k, k - 1), np.int64), np.zeros((k, k - 1))
    for i in range(k):
        apart = squared(centroids, centroids[i])
        order = np.argsort(apart, kind="stable")
        near[i] = order[order != i]
        gaps[i] = np.sqrt(apart[near[i]]) * (1 - SLACK)
    half = gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
    return Geometry(centroids, near, gaps, half)


def drifted(
    cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids have moved by so much at most."""
    far = int(moves.argmax())
    rest = np.delete(moves, far).max(initial=0.0)
    other = np.where(cluster == far, rest, moves[far])
    return (upper + moves[cluster]) * (1 + SLACK), (lower - other) - SLACK * (np.abs(lower) + other)


def _search(q: np.ndarray, start: np.ndarray, own: np.ndarray, second: np.ndarray, known: Geometry):
    """Nearest and second-nearest centroid of each row and both squared distances.

    `start` is at squared distance `own`. Ties go to the smaller number.
    """
    other = squared(q, known.centroids[second])
    swap = (other < own) | (other == own) & (second < start)
    centre, best_d = np.where(swap, second, start), np.where(swap, other, own)
    best, next_, next_d = centre.copy(), np.where(swap, start, second), np.where(swap, own, other)
    reach = np.sqrt(best_d)
    rows = np.arange(len(q))
    for t in range(known.near.shape[1]):
        ball = (reach[rows] + np.sqrt(next_d[rows])) * (1 + 2 * SLACK)
        rows = rows[known.gaps[centre[rows], t] <= ball]
        if not len(rows):
            break
        found = known.near[centre[rows], t]
        d = squared(q[rows], known.centroids[found])
        first = (d < best_d[rows]) | (d == best_d[rows]) & (found < best[rows])
        after = ~first & ((d < next_d[rows]) | (d == next_d[rows]) & (found < next_[rows]))
        at = rows[first]
        next_[at], next_d[at] = best[at], best_d[at]
        best[at], best_d[at] = found[first], d[first]
        at = rows[after]
        next_[at], next_d[at] = found[after], d[after]
    return best, best_d, next_, next_d


def assign(
    q: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, known: Geometry,
) -> None:
    """Bring cluster, second, upper and lower of the rows of `q` (int64) up to date, in place."""
    open_ = np.flatnonzero((upper >= lower) & (upper >= known.half[cluster]))
    own = squared(q[open_], known.centroids[cluster[open_]])
    upper[open_] = np.sqrt(own) * (1 + SLACK)
    still = (upper[open_] >= lower[open_]) & (upper[open_] >= known.half[cluster[open_]])
    open_, own = open_[still], own[still]
    best, best_d, next_, next_d = _search(q[open_], cluster[open_], own, second[open_], known)
    cluster[open_], second[open_] = best, next_
    upper[open_], lower[open_] = np.sqrt(best_d) * (1 + SLACK), np.sqrt(next_d) * (1 - SLACK)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def _assign_batches(shared, dimensions: int, moves: np.ndarray | None, last: bool):
    """Tasks of a round; the first has no moves and no bounds, the last gives distances instead of bounds."""
    def run(batches):
        known = Geometry(**shared.value)
        k = len(known.centroids)
        for batch in batches:
            q = _matrix(batch.column("q"), dimensions)
            if moves is None:
                cluster, second = np.zeros(len(q), np.int64), np.full(len(q), min(1, k - 1))
                upper, lower = np.full(len(q), np.inf), np.full(len(q), 0.0 if k > 1 else np.inf)
            else:
                cluster, second, upper, lower = (
                    batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "second", "upper", "lower"))
                cluster, second = cluster.astype(np.int64), second.astype(np.int64)
                upper, lower = drifted(cluster, upper, lower, moves)
            assign(q, cluster, second, upper, lower, known)
            out = {"vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32())}
            if last:
                out["distance"] = pa.array(squared(q, known.centroids[cluster]))
            else:
                out |= {"q": batch.column("q"), "second": pa.array(second, pa.int32()), "upper": pa.array(upper),
                        "lower": pa.array(lower)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _sum_batches(k: int, dimensions: int):
    """Number and component sums of each cluster's rows in a task."""
    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            counts += np.bincount(cluster, minlength=k)
            if len(found):
                sums[found] += np.add.reduceat(_matrix(batch.column("q"), dimensions)[order], starts, axis=0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(met, dimensions), pa.int32()),
            "component": pa.array(np.tile(np.arange(dimensions), len(met)), pa.int32()),
            "n": pa.array(np.repeat(counts[met], dimensions)), "sum": pa.array(sums[met].ravel())})

    return run


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a cluster without any keeps its centroid."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    totals = (
        state.select("cluster", "q")
        .mapInArrow(_sum_batches(*centroids.shape), "cluster int, component int, n long, sum long")
        .groupBy("cluster", "component").agg(wide("n"), wide("sum"))
    )
    out = centroids.copy()
    for row in totals.collect():  # one row per centroid and component
        out[row["cluster"], row["component"]] = int(row["sum"]) // int(row["n"])
    return out


def whole_vectors(
    vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id and q (array of int): floor(scale * x) of each vector with that many finite components."""
    largest = isqrt((1 << 62) // dimensions) // 2
    whole = lambda x: F.when(
        F.abs(x.cast("double") * scale) <= largest, F.floor(x.cast("double") * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component is above {largest / scale:.0f}: squared distances don't fit 64 bits")).cast("int"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = named(vector_col)
    return vectors.filter((F.size(vector) == dimensions) & F.forall(vector, finite)).select(
        named(id_col).alias("vec_id"), F.transform(vector, whole).alias("q"))


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
    seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[dict]]:
    """vec_id, cluster and distance (squared) of each vector, and the clusters.

    Kept are vectors with `dimensions` components, none null, NaN or infinite,
    as whole numbers floor(scale * x). Centroids start as the k kept vectors with
    the smallest sha256 of "<seed>:<vec_id>", equal ones by their components; a
    null id counts as empty text. Each round assigns every vector to its nearest
    centroid (ties: the smaller number) and replaces each centroid that has
    vectors by the floor of their mean; then vectors are assigned once more.
    Repeated rows and ids are vectors of their own. With fewer than k vectors
    each is a centroid; without any the result is empty. Components whose squared
    distances don't fit 64 bits (above 524,288 for 64 components and scale 256)
    are an error. Other columns are ignored.

    A cluster is a dictionary: centroid (list of int), size and inertia. A round
    reads the vectors with their bounds and writes them again; tables of earlier
    rounds are removed. Only the sums of the k centroids' components reach the driver.
    """
    spark = vectors.sparkSession
    state = stage(whole_vectors(vectors, dimensions, scale, id_col, vector_col), "vectors")
    kind = state.schema["vec_id"].dataType.simpleString()
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select("q", rank.alias("rank")).orderBy("rank", "q").limit(k).collect()
    if not first:
        return state.selectExpr("vec_id", "cast(null as int) cluster", "cast(null as long) distance"), []
    centroids, moves, path = np.array([r["q"] for r in first], np.int64), None, None
    for turn in range(rounds + 1):
        last = turn == rounds
        shared = spark.sparkContext.broadcast(vars(geometry(centroids)))
        schema = f"vec_id {kind}, cluster int, distance long" if last else STATE.format(kind=kind)
        columns = [c.split()[0] for c in schema.split(", ")]
        run = _assign_batches(shared, dimensions, moves, last)
        earlier, path = path, new_path(spark, "assigned")
        state.mapInArrow(_in_order(run, columns), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        shared.destroy()
        if earlier:
            remove(spark, earlier)
        if not last:
            moved = _updated(state, centroids)
            moves = np.sqrt(squared(moved, centroids)) * (1 + SLACK)
            centroids = moved
    totals = {r["cluster"]: r for r in state.groupBy("cluster").agg(
        F.count("*").alias("size"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    return state, [
        {"centroid": c.tolist(), "size": totals[i]["size"] if i in totals else 0,
         "inertia": int(totals[i]["inertia"]) if i in totals else 0} for i, c in enumerate(centroids)]


def _in_order(run, columns: list[str]):
    """The batches of `run` with their columns in this order."""
    def ordered(batches):
        for batch in run(batches):
            yield batch.select(columns)

    return ordered


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clusters = cluster(table(spark, sf_dir, "embeddings"))
    about = spark.createDataFrame(
        [(i, c["inertia"], ",".join(map(str, c["centroid"]))) for i, c in enumerate(clusters)],
        "cluster int, cluster_inertia long, components string")
    return rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(sum(c["inertia"] for c in clusters)).cast("long").alias("inertia"),
        F.sha2("components", 256).alias("centroid_sha256"))


QUERIES["op11_centroid_clusters"] = op11_centroid_clusters


def _oracle() -> str:
    """Every round by all pairs of vectors and centroids."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY rank, q) - 1 AS c, q
  FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::varchar, '')) AS rank, q FROM v ORDER BY rank, q LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, min(d * {CENTROIDS} + c) % {CENTROIDS} AS c, min(d * {CENTROIDS} + c) // {CENTROIDS} AS d
  FROM (SELECT r, c, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.q, c{i}.q)]) AS d FROM v, c{i}) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n
        FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v JOIN a{i} USING (r)) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(e.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} e USING (c)
"""


ORACLES["op11_centroid_clusters"] = _oracle()
