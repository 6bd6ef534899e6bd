import hashlib
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest

from ledgerfold.llm.warc import _assemble, chunked, payload_of, read_archives, records, resolved, unchunked, write_archives

LONG = "ö<p>line\r\n\r\nWARC/1.1\r\n" * 3000


def page_rows():
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i % 7 * 40)) for i in range(40)]
    rows += [(100 + i, "u", "x" * 999) for i in range(3)] + [(200 + i, None, "y" * 1000) for i in range(5)]
    rows += [(300 + i, "a b\r\nc", LONG) for i in range(4)] + [(400, "u", None), (401, "u", ""), (None, "u", "y" * 1000)]
    return rows + [(500, "u", "z" * 2000), (500, "u", "z" * 2000), (None, "u", "null" * 500), (None, "u", "null" * 500)]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    frame = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    clashes = [f"page_id as {c}" for c in ("rank", "digest", "content", "bytes", "name", "origin", "record", "segment")]
    frame.selectExpr("*", *clashes).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        facts = (len(data), hashlib.sha1(data).hexdigest())
        ids = sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)
        first = 1 if len(data) >= 1000 else len(ids)
        out += [(str(i), *facts, "response", "None") for i in ids[:first]]
        out += [(str(i), *facts, "revisit", str(ids[0])) for i in ids[first:]]
    return sorted(out)


def test_round_trip(spark, pages, tmp_path):
    write_archives(pages, str(tmp_path / "w"), segment=500, chunk=64)
    found = read_archives(spark, str(tmp_path / "w"))
    assert sorted(str(r["payload"] and bytes(r["payload"]).decode()) for r in found.collect()
                  if r["record_type"] == "response" and r["payload"]) == sorted(x for x in expected_payloads() if x)
    facts = resolved(found).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in facts)
    assert got == brute(page_rows())


def expected_payloads():
    """One payload for each response."""
    seen, out = set(), []
    for _, _, html in page_rows():
        if len((html or "").encode()) < 1000 or html not in seen:
            out.append(html or "")
        seen.add(html)
    return out


def test_files_are_warc_records(spark, pages, tmp_path):
    write_archives(pages, str(tmp_path / "w"), segment=700)
    seen = []
    for path in Path(tmp_path / "w").glob("part-*"):
        seen += list(records(path.read_bytes()))
    kinds = [f[b"warc-type"] for f, _ in seen]
    assert {b"response", b"revisit", b"continuation"} == set(kinds)
    assert len({f[b"warc-record-id"] for f, _ in seen}) == len(seen)
    for fields, block in seen:
        assert len(block) <= 700
        if fields[b"warc-type"] == b"continuation":
            assert int(fields[b"warc-segment-number"]) > 1 and b"warc-segment-origin-id" in fields


def test_lost_segment_is_found():
    block = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    parts = [{"segment": i + 1, "total": len(block) if i == 1 else 0, "block": p} for i, p in enumerate([block[:9], block[9:]])]
    digest = hashlib.sha1(b"abcdef").hexdigest()
    frame = lambda segments, d=digest: iter([pd.DataFrame({"segments": [segments], "digest": [d]})])
    assert next(_assemble(frame(parts)))["payload"][0] == b"abcdef"
    for broken in (parts[:1], parts[1:], [parts[0], parts[0], parts[1]], [parts[0], parts[1] | {"block": b"x"}]):
        with pytest.raises(ValueError):
            next(_assemble(frame(broken)))
    with pytest.raises(ValueError):
        next(_assemble(frame(parts, "0" * 40)))


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_chunks(size):
    data = bytes(range(256)) * 4
    assert unchunked(chunked(data[:size], 64)) == data[:size]
    assert unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + chunked(data[:size], 7)) == data[:size]
    with pytest.raises(ValueError):
        unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    write_archives(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    assert resolved(read_archives(spark, str(tmp_path / "w"))).count() == 0
