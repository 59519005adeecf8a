"""A task that compares near copies holds few pairs at a time."""

import numpy as np
import pyarrow as pa

from cohortloom.llm import simhash_texts as st


def test_near_copies_are_compared_in_small_slices(monkeypatch):
    n, seen, plain = 1200, [], st.lightest_forest
    monkeypatch.setattr(st, "lightest_forest", lambda items, u, v, w: seen.append(len(u)) or plain(items, u, v, w))
    long, bits = (lambda x: pa.array(np.array(x, dtype=np.int64))), st.sketch(np.arange(100, dtype=np.uint64)).tobytes()
    same = lambda x: long(np.full(n, x))
    batch = pa.record_batch({"item": same(1), "chunk_a": same(0), "chunk_b": same(0), "chunk": same(0), "component": long(np.arange(n)), "node": long(np.arange(n)), "n": same(100), "fp": same(7), "sketch": pa.array([bits] * n, pa.binary())})
    found = [p for b in st._candidates(st.WIDE, st.LEAST, True)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) == n - 1 and {x for p in found for x in p} == set(range(n))
    assert max(seen) <= 64 * (1 << 12) + n
