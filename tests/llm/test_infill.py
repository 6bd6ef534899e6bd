import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.llm.infill import SPAN, Array, Bitmap, BoundarySet, Runs, boundaries, fill_in_middle, restored

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """The output of a document, token by token."""
    text, name = text or "", "" if doc_id is None else str(doc_id)
    units, digest = TOKEN.findall(text), sha256(f"1:{name}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def member(kind, rng):
    if kind == "sparse":
        return rng.random(3 * SPAN + 17) < 0.01
    if kind == "half":
        return rng.random(2 * SPAN + 5) < 0.5
    if kind == "runs":
        return np.repeat(rng.random(400) < 0.5, rng.integers(1, 900, 400))
    return np.concatenate([np.ones(SPAN, bool), np.zeros(SPAN, bool), rng.random(SPAN) < 0.4, np.ones(9, bool)])


@pytest.mark.parametrize("kind, container", [("sparse", Array), ("half", Bitmap), ("runs", Runs), ("mixed", None)])
def test_select_in_each_container(kind, container):
    flags = member(kind, np.random.default_rng(3))
    found, ends = BoundarySet(flags), np.flatnonzero(flags) + 1
    assert len(found) == len(ends) and found.after(0) == 0
    if container:
        assert all(isinstance(c, container) for c in found.containers[:-1])
    else:
        assert {type(c) for c in found.containers} == {Array, Bitmap, Runs}
    places = np.unique(np.concatenate([[0, len(ends) - 1], np.random.default_rng(4).integers(0, len(ends), 500)]))
    places = np.union1d(places, np.searchsorted(ends, np.arange(SPAN, len(flags), SPAN)).clip(1) - 1)
    assert [found.after(int(i) + 1) for i in places] == ends[places].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ9 \n\x00é日🙂<PSM>@[`{"), max_size=60))
def test_boundaries_are_the_ends_of_tokens(text):
    found = boundaries(text)
    assert [found.after(i) for i in range(len(found) + 1)] == [0, *(m.end() for m in TOKEN.finditer(text))]


def test_rows_equal_the_plain_version(spark, edge_docs, edge_rows):
    more = ["<P>", "a <S> b", "<M", "P> <P", "ab<", "<<<>>>", "x\x00y z\x00", "\r\n", "ab1" * 60_000, "word " * 50_000]
    frame = spark.createDataFrame(
        [*((r[0], r[1]) for r in edge_rows), *((i, t) for t in more for i in (1, 2, 3, 4, None))], "doc_id long, text string")
    got = [tuple(r) for r in fill_in_middle(frame).collect()]
    want = [(r["doc_id"], *plain(r["doc_id"], r["text"])) for r in frame.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    stored = fill_in_middle(edge_docs)
    assert sorted(map(str, stored.collect())) == sorted(map(str, fill_in_middle(edge_docs.select("doc_id", "text")).collect()))


def test_texts_come_back(spark, edge_rows):
    frame = spark.createDataFrame([(i, r[1]) for i, r in enumerate(edge_rows * 6)], "doc_id long, text string")
    back = fill_in_middle(frame).select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in frame.collect()}


def test_empty_table_and_other_names(spark, empty_docs):
    assert fill_in_middle(empty_docs).collect() == []
    frame = spark.createDataFrame([("k.1", "a b c")], "`my.id` string, body string")
    assert fill_in_middle(frame, moved_percent=0, id_col="my.id", text_col="body").collect()[0]["output"] == "a b c"
    assert fill_in_middle(frame, moved_percent=100, spm_percent=100, id_col="my.id", text_col="body").collect()[0]["form"] == "spm"
