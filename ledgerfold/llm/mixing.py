"""Mixing sources to target weights without a sort of the documents.

Each document has a hash. Per source, word counts are summed by the leading
digits of the hash; the running sums over these buckets tell in which bucket the
budget ends. Only that bucket is refined by the next digits, level by level,
until one document is left, so the thresholds of larger budgets contain those of
smaller ones. A filter on hashes then selects the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import KEY, WORD, named, positional, with_row_key
from .queries import ORACLES, QUERIES, table

# Weights by place of the source, share of all words, and the most rounds over a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_ROUNDS = 2
# A hash is three parts of 15 hex digits; each level of the histogram takes three more digits.
PART = 15
DIGITS = 3 * PART
LEVEL = 3


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, rounds: float = MOST_ROUNDS
) -> DataFrame:
    """The columns of `sizes` (key, source_size; one row per source) and `target`.

    Sources in order of their key get the weights in turn. A target is weight
    times a common level, at most `rounds` times the size; the targets sum up to
    the share of all sizes. That is where resharing of the excess ends. In order
    of limit / weight the first sources are at their limit, so running sums give
    the level.
    """
    ranked = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy("key")))
        .withColumn("weight", F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * float(rounds))
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    wanted = F.sum("source_size").over(every) * float(share)
    level = (wanted - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))).over(every))
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most")
    return levels.select(*sizes.columns, target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each source's budget ends: columns key, `edge` (first digits of hashes), `edge_taken`.

    `rows` has key, hash and size, `budgets` key and `extra`, less than the
    source's size. All hashes below the edge are taken, and what begins with the
    edge if that comes nearer to the budget. That is one document with words, as
    buckets are refined until they have no more.
    """
    left = budgets.select("key", F.lit("").alias("edge"), F.col("extra").alias("left"))
    for depth in range(LEVEL, DIGITS + 1, LEVEL):
        histogram = (
            rows.join(left.select("key", "edge", "left"), "key").filter(F.col("hash").startswith(F.col("edge")))
            .groupBy("key", "left", F.substring("hash", 1, depth).alias("edge"))
            .agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("documents"))
        )
        running = F.sum("size").over(Window.partitionBy("key").orderBy("edge"))
        sums = histogram.withColumn("sum", running)
        bucket = F.struct("edge", "size", "documents", (F.col("left") - F.col("sum") + F.col("size")).alias("left"))
        ends = sums.groupBy("key").agg(
            F.coalesce(F.min(F.when(F.col("sum") > F.col("left"), bucket)), F.max(bucket)).alias("end"))
        left = stage(ends.select("key", "end.*"), "thresholds")
        if left.filter("documents > 1").isEmpty():
            break
    return left.select("key", "edge", ((F.col("left") > 0) & (F.col("left") * 2 >= F.col("size"))).alias("edge_taken"))


def _source_key(source: Column) -> Column:
    """In order of code points, null last."""
    return F.when(source.isNull(), F.struct(F.lit(1).alias("none"), F.lit("").alias("name"))).otherwise(
        F.struct(F.lit(0).alias("none"), source.cast("string").alias("name")))


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    """Digits of a document: of its id; where ids repeat, of its text; where both do, of its row key."""
    part = lambda value: F.substring(value, 1, PART)
    return F.concat(
        part(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))),
        *(part(F.lpad(F.hex(x), 16, "0")) for x in (F.xxhash64(text), F.xxhash64(*KEY))))


def budgets(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, rounds: float = MOST_ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keyed: bool = False,
) -> DataFrame:
    """What the mix takes of each source, one row per source.

    Columns: key, source_size (words), target (words), whole (rounds over all
    documents), edge and edge_taken (which hashes are taken once more). With
    `keyed`, `docs` has row keys already.
    """
    rows = stage((docs if keyed else with_row_key(docs)).select(
        _source_key(named(source_col)).alias("key"), _size(named(text_col)).alias("size"),
        _hash(named(id_col), named(text_col)).alias("hash")), "sizes")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = stage(
        source_targets(sizes, weights, share, rounds).withColumn("whole", whole.cast("long"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    edges = thresholds(rows, wanted.select("key", "extra"))
    return stage(wanted.drop("extra").join(edges, "key"), "budgets")


def times(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keyed: bool = False,
) -> DataFrame:
    """The rows of `docs` with `_mix` (source_size, target, times), by the budgets found for them.

    A document's hash comes from its id, so reruns agree; documents with the same
    id (null is one, too) are told apart by their texts, and rows that repeat both
    by their place in the stored table. A frame that isn't stored has its rows
    keyed once by the caller, for `budgets` and for this. A column of `docs` named
    `_mix`, `_mix_key` or `_mix_hash` is replaced.
    """
    budget = found.select(F.col("key").alias("_mix_key"), F.struct(
        "source_size", "target", "whole", "edge", "edge_taken").alias("_mix"))
    rows = (docs if keyed else with_row_key(docs)).drop("_mix").withColumns(
        {"_mix_key": _source_key(named(source_col)), "_mix_hash": _hash(named(id_col), named(text_col))})
    edge = F.col("_mix.edge")
    value = F.substring("_mix_hash", F.lit(1), F.length(edge))
    once_more = (value < edge) | ((value == edge) & F.col("_mix.edge_taken"))
    counted = rows.join(budget, "_mix_key").withColumn("_mix", F.struct(
        "_mix.source_size", "_mix.target", (F.col("_mix.whole") + once_more.cast("long")).alias("times")))
    return counted.drop("_mix_key", "_mix_hash", *(() if keyed else KEY))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, rounds: float = MOST_ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with its columns.

    Null and empty texts have size 0; a source without words is not taken. Null is
    a source of its own and the last. Texts are counted whole. Repeated ids and
    rows are documents of their own. An empty table gives no rows.
    """
    rows = with_row_key(positional(docs))
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    names = {"id_col": place[id_col], "text_col": place[text_col], "source_col": place[source_col], "keyed": True}
    found = budgets(rows, weights, share, rounds, **names)
    taken = times(rows, found, **names).filter("_mix.times > 0")
    copies = taken.withColumn("_mix", F.explode(F.sequence(F.lit(1), F.col("_mix.times"))))
    return copies.select(*place.values()).toDF(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.withColumn("size", _size(F.col("text")))
    return times(sized, budgets(docs)).select(
        "doc_id", "size", "_mix.source_size", "_mix.target", (F.col("size") * F.col("_mix.times")).alias("taken"))


QUERIES["op3_mix_sources"] = op3_mix_sources
ORACLES["op3_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source, substr(md5(coalesce(doc_id::varchar, '')), 1, 15) AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
sizes AS (SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::double * source_size AS most FROM sizes),
weighed AS (SELECT *, [3.0::double, 1.0, 2.0][(place - 1) % 3 + 1] AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::double * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
common AS (SELECT max(level) FILTER (level * weight < most) AS level FROM levels),
targets AS (
  SELECT source, source_size, coalesce(least(most, common.level * weight), most) AS target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM levels, common),
hashes AS (SELECT source, hash, sum(size) AS size FROM docs GROUP BY source, hash),
edges AS (
  SELECT source, hash, size,
         sum(size) OVER (PARTITION BY source ORDER BY hash) - size AS before FROM hashes)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (t.whole + (e.before <= t.target - t.whole * t.source_size
                             AND 2 * (t.target - t.whole * t.source_size - e.before) >= e.size)::int))::bigint AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
JOIN edges e ON d.source IS NOT DISTINCT FROM e.source AND d.hash = e.hash
"""
