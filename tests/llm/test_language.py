import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerfold.llm.language import Filters, _grams, _scores, detect, learn, letter_table, op1_language_id


def test_held_out_accuracy(spark, documents):
    found = op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in found if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(found) == len(lang) and 150 < len(held) < 350
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_grams_of_words():
    table = letter_table()
    count = lambda text: int(_grams([text], table)[1][0])
    assert [count(t) for t in ("", "12 !", "a", "ab c", "été")] == [0, 0, 1, 3, 3]
    one, two = _grams(["ab", "c ab, 1"], table), _grams(["ab"], table)
    assert list(one[1]) == [2, 3] and (one[0][:2] == two[0]).all() and (one[0][3:] == two[0]).all()


def test_hits_equal_the_sets_up_to_false_positives():
    """With filters of two known sets: no true n-gram is missed, and the corrected counts are near the true ones."""
    from ledgerfold.llm.language import SLOT_BITS, _slots

    table, rng = letter_table(), np.random.default_rng(4)
    masks = np.zeros((1 << SLOT_BITS, 1), np.uint8)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(3000)]
    sets = [_grams([" ".join(words[:1500])], table)[0], _grams([" ".join(words[1500:])], table)[0]]
    for bit, grams in enumerate(sets):
        for slots in _slots(grams):
            masks[slots, 0] |= np.uint8(1 << bit)
    rates = np.array([((masks >> b) & 1).mean() for b in range(2)]) ** 2
    text = " ".join(words[:200])
    hits, counts = _scores([text], Filters(["a", "b"], "a", masks, rates, table))
    grams = _grams([text], table)[0]
    true = [np.isin(grams, s).sum() for s in sets]
    assert hits[0, 0] > 0.99 * counts[0] and abs(hits[0, 1] - true[1]) < 0.05 * counts[0]


def test_awkward_rows(spark, edge_docs, edge_rows):
    model = learn(edge_docs, least_count=1)
    found = detect(spark, model, F.col("text"))
    got = [(r["text"], r["f"]["lang_pred"], r["f"]["score"]) for r in edge_docs.withColumn("f", found).collect()]
    assert len(got) == len(edge_rows) and model.languages == ["de", "en", "fr"]
    for text, lang, score in got:
        lettered = any(c.isalpha() for c in text or "")
        assert (lang in model.languages) if lettered else (lang, score) == ("und", 0.0)
    assert Counter(str(t) for t, *_ in got) == Counter(str(t) for _, t, *_ in edge_rows)


def test_nothing_learned_and_empty_tables(spark, edge_docs, empty_docs):
    model = learn(empty_docs)
    assert model.languages == []
    assert {r[0] for r in edge_docs.select(detect(spark, model, F.col("text"))["lang_pred"]).collect()} == {"und"}
    assert empty_docs.select(detect(spark, model, F.col("text"))).count() == 0


def test_more_languages_than_a_mask_holds(spark):
    rows = [(f"l{i:02d}", " ".join(chr(0x4E00 + 40 * i + j % 40) * 3 for j in range(50))) for i in range(70)]
    model = learn(spark.createDataFrame(rows, "lang string, text string"), least_count=1)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert all(r["lang"] == r["p"] for r in frame.withColumn("p", detect(spark, model, F.col("text"))["lang_pred"]).collect())


def test_predictions_are_those_of_exact_sets(spark, documents):
    """With sets of n-grams instead of filters and Python counts: the same language, nearly the same score."""
    learned = [(t, lang) for i, (_, t, lang) in enumerate(documents) if i % 4 and t and lang]
    model = learn(spark.createDataFrame(learned, "text string, lang string"))
    letter = lambda c: unicodedata.category(c)[0] == "L"

    def grams(text):
        padded = ["", *(c if letter(c) else "" for c in text.lower()), "", ""]
        return [(padded[i - 1], c, padded[i + 1], padded[i + 2] if padded[i + 1] else "")
                for i, c in enumerate(padded) if c and i]

    counts = {}
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(grams(text))
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for own in share.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    known = {lang: {g for g, n in c.items() if n >= 3 and share[lang][g] >= most[g] * 0.25} for lang, c in counts.items()}
    frame = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(documents)], "i int, text string")
    found = {r["i"]: r["p"] for r in frame.select("i", detect(spark, model, F.col("text")).alias("p")).collect()}
    for i, (_, text, _) in enumerate(documents):
        own = grams(text or "")
        hits = {lang: sum(g in known[lang] for g in own) / len(own) for lang in sorted(known)} if own else {}
        if not hits:
            assert found[i]["lang_pred"] == "und"
            continue
        best = max(hits, key=hits.get)
        close = sorted(hits.values())[-2:]
        assert found[i]["lang_pred"] == best or close[1] - close[0] < 0.02
        assert abs(found[i]["score"] - hits[found[i]["lang_pred"]]) < 0.03


def test_a_language_of_copies_is_learned_from_a_sample(spark, tmp_path):
    """60,000 rows with one text: about `sample_rows` of them teach."""
    text = "un texte assez court en une langue que rien d'autre ne montre"
    rows = spark.range(60_000).select(F.lit(text).alias("text"), F.lit("fr").alias("lang"))
    other = spark.range(50).select(F.lit("the quick brown fox over a lazy dog").alias("text"), F.lit("en").alias("lang"))
    rows.unionByName(other).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for sample in (500, 4000):
        model = learn(stored, sample_rows=sample)
        found = stored.limit(1).select(detect(spark, model, F.lit(text)).alias("p")).first()["p"]
        assert found["lang_pred"] == "fr" and found["score"] > 0.95


def test_many_languages_need_no_longer_plan(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(" ".join(letters[i % 26] + letters[i // 26] + letters[j] * 3 for j in range(20)), f"l{i:03}") for i in range(130)] * 3
    model = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model.masks.shape[1] == 3
    frame = spark.createDataFrame(rows[:130], "text string, lang string")
    found = frame.select("lang", detect(spark, model, F.col("text")).alias("p")).collect()
    assert all(r["p"]["lang_pred"] == r["lang"] for r in found)
