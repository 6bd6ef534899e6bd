"""Operators and stages on frames that aren't plain reads: each row is a row of its own, as in a stored copy."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm.bpe import encode, vocabulary_path
from ledgerfold.llm.common import KEY, with_row_key
from ledgerfold.llm.exact import exact_dedup
from ledgerfold.llm.infill import fill_in_middle
from ledgerfold.llm.quality import quality
from ledgerfold.llm.records import write_index, write_records
from ledgerfold.llm.secrets import find_secrets
from ledgerfold.llm.simhash import near_duplicates
from ledgerfold.llm.substrings import substring_dedup
from ledgerfold.llm.warc import read_archives, resolved, write_archives


def _records(docs, folder):
    write_records(docs, f"{folder}/r", vocabulary_path(), files=3)
    return write_index(docs.sparkSession, f"{folder}/r", f"{folder}/i").select("doc_id", "start", "n_tokens")


def _archives(docs, folder):
    write_archives(docs, f"{folder}/w", least_revisit=40, id_col="doc_id", url_col="source", html_col="text")
    found = resolved(read_archives(docs.sparkSession, f"{folder}/w"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _stage(work):
    return lambda docs, folder: work(docs.sparkSession, docs, None)


WORK = {
    "bpe": lambda docs, _: encode(docs, vocabulary_path(), leaf=300, decoded=True),
    "exact": lambda docs, _: exact_dedup(docs),
    "quality": lambda docs, _: quality(docs),
    "secrets": lambda docs, _: find_secrets(docs),
    "simhash": lambda docs, _: near_duplicates(docs),
    "substrings": lambda docs, _: substring_dedup(docs),
    "infill": lambda docs, _: fill_in_middle(docs),
    "records": _records,
    "warc": _archives,
    **{f"stage {name}": _stage(work) for name, work in corpus_pipeline.STAGES},
}


@pytest.fixture(scope="module")
def frames(spark, edge_docs, edge_rows, tmp_path_factory):
    """Each kind of frame with a stored copy of it."""
    plain = edge_docs.select("doc_id", "text", "lang", "source")
    other = spark.range(2).withColumnRenamed("id", "copy")
    made = {
        "exploded": plain.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy"),
        "joined": plain.join(F.broadcast(other)).drop("copy"),
        "union": plain.union(plain.filter("doc_id > 30")),
        "made": spark.createDataFrame(edge_rows * 2, "doc_id long, text string, lang string, source string"),
        "filtered": plain.filter("doc_id > 20").withColumn("text", F.concat("text", F.lit(" end"))),
    }
    out = {}
    for name, frame in made.items():
        path = str(tmp_path_factory.mktemp("frames") / name)
        frame.write.parquet(path)
        out[name] = frame, spark.read.parquet(path)
    return out


@pytest.mark.parametrize("kind", ["exploded", "joined", "union", "made", "filtered"])
def test_row_keys_differ(frames, kind):
    frame, stored = frames[kind]
    assert with_row_key(frame).select(*KEY).distinct().count() == stored.count()


def result(frame, work, folder):
    found = work(frame, str(folder))
    plain = found.drop(*KEY)
    return sorted(map(str, plain.collect())), found.columns


@pytest.mark.parametrize("kind", ["exploded", "union", "made"])
@pytest.mark.parametrize("name", sorted(WORK))
def test_rows_equal_those_of_a_stored_copy(frames, tmp_path, kind, name):
    frame, stored = frames[kind]
    got, columns = result(frame, WORK[name], tmp_path / "a")
    want, names = result(stored, WORK[name], tmp_path / "b")
    assert columns == names and got == want and (got or name == "stage language id")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(edge_docs, name):
    """The stored rows with clashing columns come out with them, as without them."""
    work = dict(corpus_pipeline.STAGES)[name]
    plain = work(edge_docs.sparkSession, edge_docs.select("doc_id", "text", "lang", "source"), None)
    whole = work(edge_docs.sparkSession, edge_docs, None)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert whole.columns == edge_docs.columns
        assert all(r["_mix"] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in whole.collect())
    assert sorted(map(str, whole.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
