import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm.preference import (
    BLOCK_CHARS, CHUNK, CLASSES, WORD_FEATURES, class_table, features, fit, learn, op13_quality_ranking, preference_pairs,
    quality_score, rank, score_quantile,
)

TABLE = class_table()


def test_features_of_odd_texts():
    width = len(features("", TABLE))
    assert width == 2 * CLASSES + 2 + WORD_FEATURES and not features("", TABLE).any() and not features(None, TABLE).any()
    for text in (" \n\t", "a", "a b", "\x00", "a\x00 a\x00b", "é日🙂", "|", "x" * 5000, "a\n" * 9):
        found = features(text, TABLE)
        assert found.shape == (width,) and np.isfinite(found).all()
    # the ends of words are ASCII white space, NUL isn't one
    assert features("a\x00b a\x00c", TABLE)[-2] == np.log1p(2) and features("a\x00b a\x00c", TABLE)[24] == 1.0


def test_long_texts_count_whole_and_in_blocks():
    prose = " ".join(random.Random(5).choices("lorem ipsum dolor sit amet consectetur elit sed".split(), k=300_000))
    assert len(prose) > CHUNK
    bad = prose[:CHUNK + 7] + "|" * BLOCK_CHARS * 2 + prose[CHUNK + 7:]
    good, mixed = features(prose, TABLE), features(bad, TABLE)
    assert good[7] == 0 and mixed[7] == pytest.approx(2 * BLOCK_CHARS / len(bad)) and mixed[CLASSES + 7] == 1.0


def test_pairs_meet_all_rows_of_the_larger_side():
    for better, worse in ((10, 3), (3, 10), (1, 1), (5, 5), (100, 7)):
        left, right = preference_pairs(better, worse, 4)
        assert len(left) == len(right) == max(better, worse) * min(4, better, worse)
        assert len(set(zip(left, right))) == len(left)
        assert set(left) == set(range(better)) and set(right) == set(range(worse)) or better * worse > 400
    assert not len(preference_pairs(0, 5)[0]) and not len(preference_pairs(5, 0)[0])


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(2)
    differences = rng.normal(size=(500, 4)) + [1, 0.5, 0, -0.5]
    weights = fit(differences, ridge=1e-2)
    loss = lambda w: np.log1p(np.exp(-differences @ w)).sum() + 0.5e-2 * 500 * w @ w
    assert all(loss(weights) <= loss(weights + step) for step in rng.normal(scale=0.01, size=(200, 4)))
    assert not fit(np.zeros((0, 4))).any()


def test_threshold_is_a_quantile_of_scores():
    raw = np.arange(10.0)
    assert score_quantile(raw, np.ones(10), 0.3) == 3.0
    assert score_quantile(raw, np.where(raw < 2, 4.0, 1.0), 0.5) == 2.0
    assert score_quantile(np.ones(5), np.ones(5), 0.5) == 1.0
    model = rank(np.ones((3, 2)), np.zeros((0, 2)), 3, 0)
    assert not model.weights.any()


def _good(rng):
    return " ".join(rng.choices("the river of stones and a house by its old tree was seen from far away".split(), k=rng.randint(20, 90))) + "."


def _bad(rng):
    return " | ".join(rng.choices("CELL ROW 12 99 TAB".split(), k=rng.randint(20, 90)))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    docs = [(i, _good(rng) if i % 4 else _bad(rng), "x", "y") for i in range(200)]
    labels = [(i, int(bool(i % 4)), 0) for i in range(0, 200, 2)]
    docs += [(None, "null id", None, None), (201, None, None, None), (202, "", None, None), docs[3], docs[4]]
    labels += [(None, 1, 0), (5000, 0, 1), (4, None, 1), (8, 7, 0), *[labels[0]] * 30]
    return (spark.createDataFrame(docs, "doc_id long, text string, label string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, text int"))


def test_learned_order_and_threshold(spark, judged):
    docs, labels = judged
    model = learn(docs, labels)
    rows = docs.select("doc_id", "text", quality_score(spark, model, F.col("text")).alias("found")).collect()
    assert len(rows) == 205 and all(0 <= r["found"] <= 1 for r in rows)
    marked = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 200]
    good, bad = [r["found"] for r in marked if r["doc_id"] % 4], [r["found"] for r in marked if not r["doc_id"] % 4]
    # the threshold is a quantile of the labelled scores, so rows without a label may fall just below it
    assert min(good) > max(bad) and max(bad) < 0.3 and np.mean([x >= 0.3 for x in good]) > 0.9
    assert len({r["found"] for r in rows if not r["text"]}) == 1
    assert [a.tolist() for a in (model.weights, model.mean)] == [a.tolist() for a in (learn(docs, labels).weights, model.mean)]


def test_copies_of_a_row_teach_once(spark, judged):
    docs, labels = judged
    copies = docs.filter("doc_id = 0").crossJoin(spark.range(300)).drop("id")
    assert np.allclose(learn(docs.unionByName(copies), labels).weights, learn(docs, labels).weights)


def test_sample_is_bounded(spark, judged):
    docs, labels = judged
    model = learn(docs, labels, sample_rows=10)
    assert model.weights.any()
    found = docs.filter("doc_id < 200").select("doc_id", quality_score(spark, model, F.col("text")).alias("found")).collect()
    assert np.mean([(r["found"] >= 0.3) == bool(r["doc_id"] % 4) for r in found]) > 0.95


def test_without_labels_all_texts_are_alike(spark, judged, empty_docs):
    docs, labels = judged
    for given in (labels.limit(0), labels.filter("quality = 1")):
        found = docs.select(quality_score(spark, learn(docs, given), F.col("text")).alias("found")).distinct().collect()
        assert [r["found"] for r in found] == [pytest.approx(0.5)]
    model = learn(empty_docs, labels)
    assert empty_docs.select(quality_score(spark, model, F.col("text"))).collect() == []


def test_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op13_quality_ranking(spark, sf_dir).collect()}
    assert len(rows) == 1000
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    held = [(rows[i]["score"], rows[i]["predicted"], q) for i, q in labels if rows[i]["held_out"]]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert np.mean([p == q for _, p, q in held]) >= 0.95 and all((s >= 0.3) == bool(p) for s, p, _ in held)
