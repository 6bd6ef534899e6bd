import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerfold.llm import substrings
from ledgerfold.llm.substrings import BitVector, FMIndex, _stretches, substring_dedup, window_groups, words_of


def brute(rows, window=13):
    least = {}
    for doc_id, text in rows:
        words = words_of(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if doc_id is not None:
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        gone = {j for i in range(len(words) - window + 1) if doc_id is not None
                and least[tuple(words[i:i + window])] < doc_id for j in range(i, i + window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((str(doc_id), len(words), len(gone), kept))
    return sorted(out)


def found(docs, **options):
    rows = substring_dedup(docs, **options).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows)


def passages():
    """Documents of few words with shared passages, some at the edges, one in very many."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (12, 13, 14, 30, 80)]
    hot = " ".join(rng.choices(words, k=20))
    rows = []
    for i in range(300):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)]
        rows.append((i, " ".join([parts[0], rng.choice(shared), parts[1], hot if i % 2 else "", parts[2]])))
    rows += [(300 + i, "a b " * 40) for i in range(3)] + [(400, "z " * 200), (401, "z " * 13), (402, "z " * 12)]
    return rows


def test_documents(spark, sf_dir, documents):
    assert found(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute([(d, t) for d, t, _ in documents])


def test_awkward_rows(edge_docs, edge_rows):
    rows = [(d, t) for d, t, *_ in edge_rows]
    assert found(edge_docs) == brute(rows)


@pytest.mark.parametrize("hot", [5_000, 20])
def test_passages(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD", 100)
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_other_windows(spark):
    rows = passages()[:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, window=6, gram=4) == brute(rows, 6)


def test_empty_table(empty_docs):
    assert substring_dedup(empty_docs).count() == 0


@pytest.mark.parametrize("symbols", [4, 300_000])
def test_index_counts_and_places(symbols):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400) * symbols // 4, 0)
    index = FMIndex(text, 6)
    for length in range(1, 7):
        at = rng.integers(0, 400 - length, 50)
        low, high = np.zeros(50, np.int64), np.full(50, len(text))
        for step in range(length - 1, -1, -1):
            low, high = index.extend(text[at + step], low, high)
        for a, i, j in zip(at, low, high):
            want = [p for p in range(len(text) - length + 1) if (text[p:p + length] == text[a:a + length]).all()]
            assert sorted(index.places[i:j]) == want
            if length == 6:
                assert set(index.group[i:j]) == {index.group[i]} and (index.group == index.group[i]).sum() == len(want)
                shorter = [p for p in range(len(text)) if list(text[p:p + 5]) == list(text[a:a + 5])]
                assert sorted(index.places[index.shorter[0][i]:index.shorter[1][i]]) == shorter


@pytest.mark.parametrize("window", [2, 5, 13])
def test_streamed_windows_equal_their_text(window):
    rng = np.random.default_rng(window)
    lengths = rng.integers(window, window + 30, 40)
    ends = np.cumsum(lengths + 1)
    text = rng.integers(1, 3, ends[-1])
    text[ends - 1] = 0
    text[ends[-1] - 1 - lengths[-1]:ends[-1] - 1] = text[ends[-2] - 1 - lengths[-1]:ends[-2] - 1]
    groups, _ = window_groups(text, ends - 1, lengths, window)
    bodies = [tuple(text[e - 1 - n + j:e - 1 - n + j + window]) for e, n in zip(ends, lengths) for j in range(n - window + 1)]
    assert len(bodies) == len(groups)
    assert len(set(zip(bodies, groups))) == len(set(bodies)) == len(set(groups))


def test_ranks():
    bits = np.random.default_rng(1).integers(0, 2, 1000).astype(np.uint8)
    vector = BitVector(bits)
    assert (vector.rank(np.arange(1001)) == np.concatenate([[0], np.cumsum(bits)])).all()


def test_equal_windows_have_equal_anchors():
    texts = [words_of(t) for _, t in passages()]
    which, start, windows, anchor = _stretches(texts, 13, 5)
    anchors, covered = defaultdict(set), set()
    for w, s, n, a in zip(which, start, windows, anchor):
        for i in range(s, s + n):
            anchors[tuple(texts[w][i:i + 13])].add(a)
            assert (w, i) not in covered
            covered.add((w, i))
    assert all(len(x) == 1 for x in anchors.values())
    assert len(covered) == sum(max(0, len(t) - 12) for t in texts)
