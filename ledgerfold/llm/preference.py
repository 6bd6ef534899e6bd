"""Quality scores learned from preference pairs (Bradley and Terry's model).

A document of label 1 is preferred to one of label 0. The chance that a document
is preferred is the logistic function of a weighted difference of their
features; the weights maximize the likelihood of all pairs, with a small ridge.
The raw score of a document is its side of that difference. The quantile of the
labelled documents' raw scores at the share of label 0 is the threshold; a
logistic function centred there gives scores between 0 and 1.

Features are shares of a whole text, and the largest shares in any of its blocks,
so that a bad part of a long text counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stage
from .common import named, slices
from .queries import QUERIES, table

# Parameters: labelled rows learned from per label, pairs per row of the larger label, rounds and ridge of the fit.
SAMPLE_ROWS = 5000
PARTNERS = 8
FIT_ROUNDS = 25
RIDGE = 1e-3
# Fixed value of the query: scores from here on are predicted as label 1.
THRESHOLD = 0.3
# Code points and words per block, the least part of one, widest standardized feature, bytes handled at once.
BLOCK_CHARS, BLOCK_WORDS, LEAST_PART = 256, 64, 0.5
WIDEST = 6.0
CHUNK = 1 << 20
# Words as bytes, odd factors of three neighbouring words' hash, and features made of words.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
TRIPLE = np.array([0x1E3779B97F4A7C15, 0x42B2AE3D27D4EB4F, 0x165667B19E3779F9])
WORD_FEATURES = 13
# Classes of code points.
BLANK, LOWER, UPPER, LETTER, DIGIT, SENTENCE, EMPHASIS, BAR, SYMBOL, OTHER = range(CLASSES := 10)
SENTENCE_SIGNS = ".,;:?'\"-()"


@dataclass
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float  # the raw score that becomes `level`
    level: float


def class_table() -> np.ndarray:
    """The class of each code point."""
    by_category = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "L": LETTER, "M": LETTER, "N": DIGIT, "P": SYMBOL, "S": SYMBOL}
    category = unicodedata.category
    kinds = [category(chr(i)) for i in range(sys.maxunicode + 1)]
    out = np.fromiter((by_category.get(k, by_category.get(k[0], OTHER)) for k in kinds), np.uint8)
    for signs, kind in ((" \t\n\v\f\r", BLANK), (SENTENCE_SIGNS, SENTENCE), ("!", EMPHASIS), ("|", BAR)):
        out[[ord(s) for s in signs]] = kind
    return out


def _blocks(n: int, size: int) -> tuple[np.ndarray, int]:
    """The block of each of n places; a last part below LEAST_PART goes with the block before it."""
    count = max(1, n // size + (n % size >= LEAST_PART * size))
    return np.minimum(np.arange(n) // size, count - 1), count


def _class_counts(text: str, classes: np.ndarray) -> np.ndarray:
    """How many code points of each class each block has."""
    _, count = _blocks(len(text), BLOCK_CHARS)
    out = np.zeros((count, CLASSES), np.int64)
    for start in range(0, len(text), CHUNK):
        some = text[start:start + CHUNK]
        codes = classes[np.frombuffer(some.encode("utf-32-le", "surrogatepass"), np.uint32)]
        block = np.minimum(np.arange(start, start + len(some)) // BLOCK_CHARS, count - 1)
        first = int(block[0])
        part = np.bincount((block - first) * CLASSES + codes)
        part = np.pad(part, (0, -len(part) % CLASSES)).reshape(-1, CLASSES)
        out[first:first + len(part)] += part
    return out


def _word_numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A number per word of the text, and the bytes of each different word."""
    data, numbers = text.encode("utf-8", "surrogatepass"), {}
    # bytes: split at ASCII white space; a long text's words are not held at once
    words = data.split() if len(data) < CHUNK else (m.group() for m in WORD_BYTES.finditer(data))
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64)
    return ids, np.fromiter(map(len, numbers), np.int64, len(numbers))


def features(text: str | None, classes: np.ndarray) -> np.ndarray:
    """The features of a whole text; those of a text without words are zero but for its classes."""
    text = text or ""
    counts = _class_counts(text, classes)
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    by_class = [*(counts.sum(axis=0) / max(1, len(text))), *shares.max(axis=0), shares[:, LOWER].min(), shares[:, BLANK].min()]
    ids, sizes = _word_numbers(text)
    if not len(ids):
        return np.array([*by_class, *np.zeros(WORD_FEATURES)])
    lines = [x for x in text.split("\n") if x.strip()]
    n, lengths = len(ids), sizes[ids]
    same = np.concatenate([[False], ids[1:] == ids[:-1]])
    spot, spots = _blocks(n, BLOCK_WORDS)
    per_spot = np.bincount(spot, minlength=spots)
    distinct = np.bincount(np.unique(spot * len(sizes) + ids) // len(sizes), minlength=spots)
    triples = (ids[:-2] * TRIPLE[0] + ids[1:-1] * TRIPLE[1] + ids[2:] * TRIPLE[2]) if n > 2 else ids[:1]
    return np.array([
        *by_class, same.mean(), (np.bincount(spot, same, spots) / per_spot).max(),
        len(sizes) / n, (distinct / per_spot).min(), np.bincount(ids).max() / n, 1 - len(np.unique(triples)) / len(triples),
        (lengths <= 3).mean(), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n), min(1.0, n / 10)])


def preference_pairs(better: int, worse: int, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides of the pairs: each row of the larger side meets up to `partners` of the other."""
    if not better or not worse:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    larger, smaller = max(better, worse), min(better, worse)
    times = min(partners, smaller)
    many = np.tile(np.arange(larger), times)
    few = (many + np.repeat(np.arange(times), larger) * max(1, smaller // times)) % smaller
    return (many, few) if better >= worse else (few, many)


def fit(differences: np.ndarray, rounds: int = FIT_ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the least logistic loss over the pairs' feature differences (better less worse), by Newton's steps."""
    pairs, width = differences.shape
    weights = np.zeros(width)
    for _ in range(rounds if pairs else 0):
        chance = 1 / (1 + np.exp(-np.clip(differences @ weights, -50, 50)))
        slope = differences.T @ (1 - chance) - ridge * pairs * weights
        bend = (differences * (chance * (1 - chance))[:, None]).T @ differences + ridge * pairs * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def score_quantile(raw: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The least raw score with more than `share` of the rows' weight at or below it."""
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    target = share * below[-1] * (1 + 1e-9)  # sums of weights are rounded
    return float(raw[order][min(len(raw) - 1, int(np.searchsorted(below, target, "right")))])


def _standard(values: np.ndarray, model: Ranker) -> np.ndarray:
    return np.clip((values - model.mean) / model.spread, -WIDEST, WIDEST)


def rank(better: np.ndarray, worse: np.ndarray, n_better: int, n_worse: int, level: float = THRESHOLD) -> Ranker:
    """The model of feature rows of both labels, of which the whole table has so many."""
    width = max(better.shape[1], worse.shape[1])
    logit = float(np.log(level / (1 - level)))
    if not len(better) or not len(worse):
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), logit, level)
    rows = np.concatenate([better, worse])
    spread = rows.std(axis=0)
    model = Ranker(np.zeros(width), rows.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), 0.0, level)
    good, bad = _standard(better, model), _standard(worse, model)
    left, right = preference_pairs(len(good), len(bad))
    model.weights = fit(good[left] - bad[right])
    raw = np.concatenate([good, bad]) @ model.weights
    weight = np.repeat([n_better / len(good), n_worse / len(bad)], [len(good), len(bad)])
    model.threshold = score_quantile(raw, weight, n_worse / (n_better + n_worse))
    return model


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", level: float = THRESHOLD,
) -> Ranker:
    """A model learned from at most `sample_rows` documents of each label, 1 and 0.

    They are those whose labels have the smallest hashes, so a rerun learns the
    same. A label given several times counts once, as does a repeated document;
    an id with both labels teaches both. Null ids, other labels and labels
    without a document teach nothing. Without documents of both labels, all
    texts score 0.5. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = labels.select(named(id_col).alias("label_id"), named(label_col).cast("int").alias("label")).filter(
        "label_id is not null and label in (0, 1)").dropDuplicates(["label_id", "label"])
    totals = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [given.filter(F.col("label") == v).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows) for v in (1, 0)]
    shared = spark.sparkContext.broadcast(class_table())

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = [features(t.as_py(), shared.value) for t in texts]
        return pa.array(rows, pa.list_(pa.float64()))

    text = F.coalesce(named(text_col), F.lit(""))
    teachers = stage(  # the broadcast side has 2 * sample_rows rows at most
        docs.select(named(id_col).alias("label_id"), text.alias("text"))
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "label_id")
        .select("label", F.xxhash64("label_id", "text").alias("row"), measured("text").alias("features"))
        .dropDuplicates(["label", "row"]), "teachers")
    width = len(features("", shared.value))
    rows = [
        np.array([r["features"] for r in teachers.filter(F.col("label") == v).orderBy("row").limit(sample_rows).collect()])
        .reshape(-1, width) for v in (1, 0)]
    return rank(*rows, totals.get(1, 0), totals.get(0, 0), level)


def quality_score(spark: SparkSession, model: Ranker, text: Column) -> Column:
    """The score of a text column, 0 to 1; `model.level` is where the quantile's threshold lies.

    Null and empty texts are scored by their features, which are zero. Equal
    texts score alike. Whole texts count, whatever their length.
    """
    shared = spark.sparkContext.broadcast((class_table(), vars(model)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        classes, known = shared.value[0], Ranker(**shared.value[1])
        logit = np.log(known.level / (1 - known.level))
        out = []
        for some in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", CHUNK):
            rows = np.array([features(t.as_py(), classes) for t in some.column("text")])
            raw = _standard(rows, known) @ known.weights - known.threshold + logit
            out.append(1 / (1 + np.exp(-np.clip(raw, -500, 500))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def held_out() -> Column:
    """Whether the contract keeps a row of `documents` out of learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op13_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES["op13_quality_ranking"] = op13_quality_ranking
