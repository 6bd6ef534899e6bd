import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerfold.llm.bpe import Encoder, decode, encode, halves, vocabulary_path

from .conftest import texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_texts_like_the_library(encoder, library, documents):
    some = [t or "" for t in texts()] + [t for _, t, _ in documents]
    assert [x.tolist() for x in encoder.encode(some)] == [ids(library, t) for t in some]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'<|>endoftextsrvml019aA.é\x1c "), st.characters(codec="utf-8"))))
def test_any_text_like_the_library(encoder, library, text):
    assert encoder.encode([text])[0].tolist() == ids(library, text)


def tree(encoder, text, leaf):
    return encoder.tree([(p, encoder.encode([p])[0]) for p in halves(text, leaf)]).tolist()


def unsplit():
    rng = random.Random(3)
    return [
        "x" * 9000, "ab" * 4000, "".join(rng.choices("abcdefghij", k=7000)), "".join(rng.choices("ab", k=5000)),
        "".join(rng.choices("aB3+/=", k=6000)), " " * 4000 + "end", "=-" * 3000, "🙂é" * 2000, "'s" * 3000,
        "<|endoftext|>" * 500, "a<|endoftext|>b " * 400, "don't we'll " * 500, "\n \n" * 1500,
        "".join(rng.choices("word 's\n12é", k=8000)),
    ]


@pytest.mark.parametrize("place", range(14))
def test_tree_of_long_texts(encoder, library, place):
    text = unsplit()[place]
    for leaf in (150, 700, 2048):
        assert tree(encoder, text, leaf) == ids(library, text)


def test_windows_stay_small_in_a_long_text_without_cuts(encoder):
    text = "".join(random.Random(5).choices("abcdefghij", k=40_000))
    parts = [(p, encoder.encode([p])[0]) for p in halves(text, 20_000)]
    sizes, whole = [], encoder.whole
    encoder.whole = lambda t: sizes.append(len(t)) or whole(t)
    try:
        encoder.join(*parts)
    finally:
        del encoder.whole
    assert max(sizes) < 2000


def test_frames_round_trip(spark, edge_docs, edge_rows, library):
    found = decode(encode(edge_docs, vocabulary_path(), leaf=300).withColumnRenamed("doc_id", "d"), vocabulary_path())
    assert sorted(r["text"] for r in found.collect()) == sorted(t or "" for _, t, *_ in edge_rows)
    encoded = encode(edge_docs, vocabulary_path(), leaf=300, decoded=True).collect()
    assert sorted(r["decoded"] for r in encoded) == sorted(t or "" for _, t, *_ in edge_rows)
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded)
    assert got == sorted((str(d), ids(library, t or "")) for d, t, *_ in edge_rows)


def test_query(spark, sf_dir, documents, library):
    from ledgerfold.llm.bpe import op2_bpe_round_trip

    found = {r["doc_id"]: r for r in op2_bpe_round_trip(spark, sf_dir).collect()}
    for doc_id, text, _ in documents:
        tokens = ids(library, text)
        row = found[doc_id]
        assert row["n_tokens"] == len(tokens)
        assert row["ids_sha256"] == hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(tokens, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(empty_docs):
    assert encode(empty_docs, vocabulary_path()).count() == 0
