import re
from collections import defaultdict
from fractions import Fraction

from ledgerfold.llm.mixing import budgets, mix, times

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """By resharing of the excess, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, Fraction(0))
    left, open_ = Fraction(3, 2) * sum(sizes.values()), set(order)
    while left and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = Fraction(0)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return target


def check(docs, rows):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    want = targets(sizes)
    found = times(docs, budgets(docs)).select("doc_id", "source", "text", "_mix.*").collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r["times"] in (0, 1, 2) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(want[r["source"]])) < 1e-6
        taken[r["source"]] += r["times"] * len(WORD.findall(r["text"] or ""))
    repeats = len(rows) - len({(d, s) for d, _, s in rows})
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] * (1 + repeats)
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["times"] for r in found)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_awkward_rows(edge_docs, edge_rows):
    check(edge_docs, [(d, t, s) for d, t, _, s in edge_rows])


def test_reruns_agree(edge_docs):
    runs = [sorted(map(str, times(edge_docs, budgets(edge_docs)).select("doc_id", "_mix").collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_empty_tables(spark, empty_docs, tmp_path):
    assert mix(empty_docs).count() == 0
    spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "blank"))
    assert mix(spark.read.parquet(str(tmp_path / "blank"))).count() == 0
