import hashlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerfold.llm.bpe import vocabulary_path

from .test_mixing import WORD, targets
from .test_simhash import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    """Each stage on what the one before has kept, against a plain version of its decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, work) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        work(spark, docs, sf_dir).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        after = [tuple(r) for r in docs.collect()]
        if place < 4:
            assert docs.columns == COLUMNS
        if name == "language id":
            assert sorted(after) == sorted(r for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "exact dedup":
            last = {}
            for r in sorted(before):
                last[r[1].translate({c: c + 32 for c in range(65, 91)})] = r
            assert sorted(after) == sorted(last.values())
        elif name == "simhash near-dedup":
            found = brute_components([(r[0], r[1]) for r in before])
            assert sorted(r[0] for r in after) == sorted(d for d, _, c in found if d == c)
        elif name == "mixing sources":
            sizes, taken = defaultdict(int), defaultdict(int)
            for rows, into in ((before, sizes), (after, taken)):
                for r in rows:
                    into[r[3]] += len(WORD.findall(r[1]))
            want = targets(sizes)
            longest = max(len(WORD.findall(r[1])) for r in before)
            assert set(after) <= set(before) and all(abs(taken[s] - want[s]) <= longest for s in sizes)
        else:
            library = Tokenizer.from_file(vocabulary_path())
            want = []
            for r in before:
                ids = library.encode(r[1], add_special_tokens=False).ids
                data = np.array(ids, "<u4").tobytes()
                want.append((r[0], len(ids), data, hashlib.sha256(data).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
            assert sorted((a, b, bytes(c), d, e) for a, b, c, d, e in after) == sorted(want)


def test_run_equals_the_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert found.count() > 0


def test_awkward_rows(spark, edge_docs, empty_docs, tmp_path):
    for name, docs in (("edge", edge_docs), ("empty", empty_docs)):
        for place, (_, work) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            path = str(tmp_path / f"{name}{place}")
            work(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            assert place == 4 or docs.columns == columns
        assert (docs.count() > 0) == (name == "edge")
