"""Exact, SimHash and embedding deduplication against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.llm import embed_dedup, exact_dedup, simhash
from cohortloom.llm.common import spanning_labels
from cohortloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, component_id string, digest string, slot int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], DOCS)


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    for b in range(64):
        bits |= (2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b
    return bits


def components_of(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


TEXTS = ["", None, "  \n\t", "one", "One", "one two", "A b c", "a B C", "a b c d", "İ x É \x0b y", "long " * 5000, "x" * 20000, "1 2 3 4 5 6 7 8", "the quick brown fox jumps over the lazy dog"]


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_plain_one(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_slices_are_summed(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    text = " ".join(f"w{i % 91}" for i in range(500))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 24])
def test_bit_sliced_pairs_are_all_near_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]])
    prints = np.concatenate([prints, prints[:100] ^ np.uint64(0b10101)])
    low, high = np.arange(len(prints)) + 1, np.full(len(prints), len(prints))
    u, v = simhash.near_pairs(prints, low, high, radius, slice_words=97)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    assert {(a, b) for a, b in zip(u.tolist(), v.tolist())} == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))))}


@pytest.mark.parametrize("bucket", [4, 4096])
def test_near_duplicates_equal_brute_force(spark, bucket):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = list(enumerate(TEXTS))
    for i in range(60):
        text = [rng.choice(words) for _ in range(80)]
        for j in range(4):
            rows.append((1000 + 10 * i + j, " ".join(text)))
            text[rng.randrange(80)] = rng.choice(words)
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in found.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: c for i, (_, c) in found.items()} == components_of(list(prints), links)
    distinct = spark.createDataFrame([(np.uint64(p).astype(np.int64).item(), i) for p, i in {p: i for i, p in sorted(prints.items(), reverse=True)}.items()], "fp long, node long")
    split = {(r.u, r.v) for r in simhash.near_links(distinct, bucket=bucket).collect()}
    ids = [r.node for r in distinct.collect()]
    assert components_of(ids, split) == components_of(ids, [(a, b) for a, b in links if a in ids and b in ids])


def test_near_duplicates_without_rows_or_ids(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    found = simhash.near_duplicates(docs_of(spark, [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words are here")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_near_duplicates_link_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[:-n] + ["other"] * n if n else words)
    prints = {n: slow_fingerprint(text(n)) for n in range(0, 40)}
    # A chain of three texts whose ends are over 3 bits apart; its middle has no id.
    chain = next((a, b, c) for a in prints for b in prints for c in prints if 0 < (prints[a] ^ prints[b]).bit_count() <= 3 and 0 < (prints[b] ^ prints[c]).bit_count() <= 3 < (prints[a] ^ prints[c]).bit_count())
    rows = [(5, text(chain[0])), (None, text(chain[1])), (9, text(chain[2])), (5, "quite another text here"), (None, "nothing like the others at all")]
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 5)]


@pytest.mark.parametrize("fan_in", [2, 16])
@pytest.mark.parametrize("largest", [True, False])
def test_exact_duplicates(spark, fan_in, largest):
    rows = list(enumerate(TEXTS * 3)) + [(900 + i, "hot text") for i in range(300)] + [(5000, "Hot TEXT"), (5000, "hot text")]
    found = exact_dedup.exact_duplicates(docs_of(spark, rows).repartition(7), largest=largest, fan_in=fan_in).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, (max if largest else min)(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in found) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_duplicates_edges(spark):
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).collect() == []
    found = exact_dedup.exact_duplicates(docs_of(spark, [(None, "a"), (3, "A"), (None, "b"), (None, None), (4, "")])).collect()
    assert sorted(((r.doc_id or -1), (r.keep_id or -1), r.group_size, r.kept) for r in found) == [(-1, -1, 1, True), (-1, 3, 2, False), (-1, 4, 2, False), (3, 3, 2, True), (4, 4, 2, True)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 30)] + [(50, 50), (None, 3)] + [(201, 200), (202, 201), (202, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == components_of({x for p in real for x in p}, real)


def test_spanning_labels():
    assert spanning_labels(6, np.array([4, 3]), np.array([5, 4])).tolist() == [0, 1, 2, 3, 3, 3]


def vectors(n=240, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, 16))
    rows = np.concatenate([base + 0.04 * rng.normal(size=base.shape) for _ in range(6)]).astype(np.float32)
    return [(i, rows[i].tolist(), int(i % 3) if i % 11 else None) for i in range(len(rows))]


@pytest.mark.parametrize("interval", [8, 512])
def test_embedding_near_duplicates_equal_brute_force(spark, interval):
    rows = vectors()
    rows += [(1000 + i, rows[4][1], rows[4][2]) for i in range(40)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [math.nan] * 16, 1), (2003, [None] * 16, 1), (2004, [math.inf] + [0.0] * 15, 1), (2005, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit(1)).withColumn("raw", F.lit("x"))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, interval=interval).collect()}
    good = [(i, np.array(v, dtype=np.float32).astype(float), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for n, (a, x, la) in enumerate(good) for b, y, lb in good[n + 1 :] if la == lb and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    low = components_of([r[0] for r in rows], links)
    count = dict.fromkeys(low, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert links and found == {i: (count[i], low[i], low[i] == i) for i in low}


def test_embedding_recall_is_full_on_large_intervals_of_one_label(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist(), 5) for i in range(900)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, threshold=0.9, interval=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist()))


def test_embeddings_that_share_or_lack_an_id(spark):
    turn = lambda a: [math.cos(a), math.sin(a)]
    rows = [(5, turn(0.0), 1), (5, turn(1.5), 1), (8, turn(0.15), 1), (None, turn(0.3), 1), (9, turn(0.45), 1), (None, turn(3.0), 1), (None, None, 1), (5, None, 1)]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    # 0.3 apart is below a cosine of 0.98; 0.15 apart is above.
    want = [(5, 1, 5, True), (5, 0, 5, True), (8, 2, 5, False), (None, 2, 5, False), (9, 1, 5, False), (None, 0, None, False), (None, 0, None, False), (5, 0, 5, True)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_embeddings_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    found = embed_dedup.near_duplicates(spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (3, [1.0], None)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(i, 0, i, True) for i in (1, 2, 3)]
