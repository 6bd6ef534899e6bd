from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from ledgerfold.llm.common import KEY
from ledgerfold.llm.exact import exact_dedup, golomb_decode, golomb_encode


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    shift, unary, rest = golomb_encode(values, 0, 1 << 64)
    assert (golomb_decode(len(values), 0, shift, unary, rest) == values).all()


def test_groups_like_brute_force(edge_docs, edge_rows):
    groups = defaultdict(list)
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text, *_ in edge_rows:
        groups[(text or "").translate(lower)].append(doc_id)
    found = exact_dedup(edge_docs).collect()
    assert len(found) == len(edge_rows)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    want = sorted((str(i), str(largest(g)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in found) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len({tuple(r[k] for k in KEY) for r in found}) == len(found)


def test_empty_table(empty_docs):
    assert exact_dedup(empty_docs).count() == 0
