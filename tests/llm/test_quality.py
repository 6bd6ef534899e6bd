import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerfold.llm.quality import derived_words, distance, features, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The base counts of one text."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(docs, rows):
    found = quality(docs).collect()
    got = sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in found)
    assert got == sorted((str(d), *brute(t)) for d, t in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        assert 0 <= r["class_distance"] <= 1 and 0 <= r["word_distance"] <= 1
        if not r["base_failed"] and r["n_words"] < 50:
            assert r["kept"]
    return found


def test_documents(spark, sf_dir, documents):
    found = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), [(d, t) for d, t, _ in documents])
    assert sum(r["kept"] for r in found) > 0.5 * len(found)


def test_awkward_rows(edge_docs, edge_rows):
    check(edge_docs, [(d, t) for d, t, *_ in edge_rows])


def test_histograms(edge_docs, edge_rows):
    blank = " \t\n\x0b\x0c\r"
    found = {r["doc_id"]: r for r in features(edge_docs).collect() if r["doc_id"] is not None}
    for doc_id, text, lang, _ in edge_rows:
        if doc_id is None or text is None:
            continue
        words = [w.lower() for w in WORD.findall(text)]
        counts = found[doc_id]["classes"]
        assert counts[0] == sum(c in blank for c in text)
        assert counts[3] == sum(c in "0123456789" for c in text)
        assert sum(counts) == len(text)
        if lang == "en":
            assert found[doc_id]["common"][0] == words.count("the")


def test_distance(spark):
    rows = [([1, 0], [5, 0]), ([1, 0], [0, 3]), ([1, 1], [1, 0]), ([0, 0], [1, 1]), ([3, 1], [1, 3])]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>").selectExpr(
        "*", "aggregate(a, 0L, (x, y) -> x + y) as a_sum", "aggregate(b, 0L, (x, y) -> x + y) as b_sum")

    def want(a, b):
        if not sum(a) or not sum(b):
            return 0.0
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        half = lambda x, y: sum(u * math.log2(2 * u / (u + v)) for u, v in zip(x, y) if u)
        return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    for r in frame.withColumn("d", distance("a", "b")).collect():
        assert math.isclose(r["d"], want(r["a"], r["b"]), abs_tol=1e-12)


def test_a_long_document_unlike_its_language_goes(spark):
    rows = [(i, "the house of the man and the dog in a town that is to be seen by all of us " * 3 + " ".join(
        f"w{i * 97 % 89 + j}x" for j in range(60)), "en") for i in range(60)]
    rows += [(100, " ".join(f"#{i}%{i * i}=$" for i in range(200)), "en"), (101, " ".join(f"#{i}%" for i in range(30)), "en")]
    found = {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not found[100] and found[101]


def test_no_python_on_the_executors(edge_docs):
    plan = quality(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "Python" not in features(edge_docs)._jdf.queryExecution().executedPlan().toString()


def test_empty_table(empty_docs):
    assert quality(empty_docs).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        words = " ".join(f"w{i * 7919 % 50021}" for i in range(n))
        frame = spark.createDataFrame([(1, words + " " + words, "en")], "doc_id long, text string, lang string")
        began = time.time()
        assert features(frame).select(F.sum("n_repeat_words")).first()[0] >= n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


def test_copies_junk_and_long_tables_move_no_reference(spark):
    rng = random.Random(17)
    words = ["house", "man", "dog", "town", "river", "garden", "letter", "morning", "window", "winter", "market", "village"]
    clean = [(i, "The " + " ".join(f"{rng.choice(words)} of {rng.choice(words)}{j}," for j in range(40)), "en") for i in range(60)]
    hot = " ".join(f"{i * 7919 % 10007}" for i in range(60))
    table = " ".join(f"{i * 7919 % 1000003}" for i in range(20000))
    failing = " ".join("12345 67890" for _ in range(2000))
    for more in ([(100 + i, hot, "en") for i in range(600)], [(100, table, "en")], [(100 + i, failing, "en") for i in range(30)]):
        docs = spark.createDataFrame(clean + more, "doc_id long, text string, lang string")
        assert all(r["kept"] for r in quality(docs, each_text_once=True).collect() if r["doc_id"] < 100)
        assert not any(r["kept"] for r in quality(docs).collect() if r["doc_id"] < 100)


def test_common_words_of_other_languages_come_from_the_table(spark):
    rng = random.Random(18)
    usual = "и в не на что с по это как он к но".split()
    syllables = ["ка", "ро", "ми", "ле", "ту", "са", "но", "ви", "до", "пе"]
    word = lambda: "".join(rng.choices(syllables, k=5))
    good = [" ".join(x for _ in range(70) for x in (rng.choice(usual), word())) for _ in range(120)]
    bad = " ".join(word() for _ in range(140))
    for lang, kept in (("ru", False), (None, False)):
        rows = [(i, t, lang) for i, t in enumerate(good)] + [(1000, bad, lang)] + [(2000 + i, "the house of the man", "en") for i in range(5)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        found = {r["doc_id"]: r for r in quality(frame).collect()}
        assert all(found[i]["kept"] for i in range(120))
        assert found[1000]["kept"] == kept and not found[1000]["base_failed"] and found[1000]["word_distance"] > 0.325


def test_derived_words_count_copies_once(spark):
    rows = [("xx", f"Ab ab cd{i % 2} e{i}") for i in range(60)] + [("xx", "zz copy")] * 500 + [("yy", "few texts")] * 500
    found = derived_words(spark.createDataFrame(rows, "lang string, text string")).orderBy("listed_lang").collect()
    assert [r["listed_lang"] for r in found] == ["xx", "yy"] and found[1]["listed"] == ["few", "texts"]
    assert {"ab", "cd0", "cd1"} < set(found[0]["listed"]) and len(found[0]["listed"]) == 25
    assert "zz" not in found[0]["listed"] and "e58" not in found[0]["listed"]


def test_no_verdict_depends_on_how_many_texts_a_language_has(spark):
    """One text more or less changes no verdict; a third of junk rows neither."""
    rng = random.Random(19)
    syllables = ["ка", "ро", "ми", "ле", "ту", "са", "но", "ви", "до", "пе"]
    usual = "и в не на что с по это как он к но".split()
    good = [" ".join(x for _ in range(70) for x in (rng.choice(usual), "".join(rng.choices(syllables, k=5)))) for _ in range(60)]
    junk = " ".join(f"{i * 7919 % 10007}" for i in range(140))
    for n in (49, 50, 60):
        rows = [(i, t, "ru") for i, t in enumerate(good[:n])] + [(1000 + i, junk, "ru") for i in range(n // 2)]
        found = quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), each_text_once=True).collect()
        assert all(r["kept"] == (r["doc_id"] < 1000) for r in found)
