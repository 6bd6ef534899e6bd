import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerfold.llm.bpe import vocabulary_path
from ledgerfold.llm.records import frame, frames, op4_token_records, payload_of, read_payload, read_shuffled
from ledgerfold.llm.records import write_index, write_records


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def want(library, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for doc_id, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


def test_query(spark, sf_dir, documents, library):
    found = sorted(tuple(r) for r in op4_token_records(spark, sf_dir).collect())
    assert found == [x[:4] for x in want(library, [(d, t) for d, t, _ in documents])]


def test_awkward_rows_and_shuffled_reads(spark, edge_docs, edge_rows, library, tmp_path):
    write_records(edge_docs, str(tmp_path / "r"), vocabulary_path(), files=5)
    index = write_index(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    expected = want(library, [(d, t) for d, t, *_ in edge_rows])
    assert [tuple(r) for r in index.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()] == [
        x[:4] for x in expected]
    orders = [[(r["doc_id"], list(r["ids"])) for r in read_shuffled(spark, index, seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(map(str, orders[0])) == sorted(str((x[0], x[4])) for x in expected)


def test_index_leads_to_each_record(spark, edge_docs, tmp_path):
    write_records(edge_docs, str(tmp_path / "r"), vocabulary_path(), files=3)
    for r in write_index(spark, str(tmp_path / "r"), str(tmp_path / "i")).collect():
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            (offset, length, payload), = frames(f.read(r["length"] + 17))
        assert read_payload(payload)[0] == r["doc_id"] and len(read_payload(payload)[1]) == r["n_tokens"]


def test_damage_is_found():
    data = frame(payload_of(5, np.arange(9, dtype=np.uint32), False)) + b"\n"
    assert [x[:2] for x in frames(data + data)] == [(0, 27), (len(data), 27)]
    for at in range(len(data)):
        with pytest.raises((ValueError, struct.error)):
            list(frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]))
    for end in range(1, len(data)):
        with pytest.raises((ValueError, struct.error)):
            list(frames(data[:end]))


def test_wide_ids_round_trip():
    ids = np.array([0, 70_000, 2**32 - 1], np.uint32)
    doc_id, back = read_payload(payload_of(None, ids, True))
    assert doc_id is None and (back == ids).all()


def test_empty_table(spark, empty_docs, tmp_path):
    write_records(empty_docs, str(tmp_path / "r"), vocabulary_path())
    index = write_index(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    assert index.count() == 0 and read_shuffled(spark, index).count() == 0


def test_rows_with_one_id_are_in_several_files(spark, tmp_path, library):
    """Three quarters of the ids are null, half of these rows are copies; NUL ends no word."""
    texts = [f"text {i % 40} of many\x00{i % 3} words" if i % 2 else "the same text" for i in range(400)]
    rows = [(i if i % 4 == 0 else None, t) for i, t in enumerate(texts)]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    write_records(frame_, str(tmp_path / "r"), vocabulary_path(), files=8)
    index = write_index(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    found = index.orderBy("start").collect()
    per_file = index.groupBy("file").count().collect()
    assert len(per_file) >= 7 and max(r["count"] for r in per_file) <= 100
    expected = want(library, rows)
    assert [r["doc_id"] for r in found] == [x[0] for x in expected]
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in found) == sorted(
        str((x[0], *x[2:4])) for x in expected)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)]).tolist()[:-1]
