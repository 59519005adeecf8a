"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles.
Fingerprints at ``radius`` or fewer differing bits link. 64 bits cut into radius + 2
blocks leave at least two blocks untouched by any ``radius`` differences, so every
linked pair meets in the bucket of some pair of blocks. Inside a bucket fingerprints
are stored vertically (one bit plane per bit, 64 fingerprints a machine word), and
the distances of one fingerprint to 64 others are counted at once by carry-save
adders in saturating vertical counters; words whose 64 lanes all exceed the radius are
abandoned. Only a spanning forest of each bucket's links leaves the kernel, so a dense
bucket never emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_pairs, group_starts, spanning_labels, store, texts_of, whole_groups
from .components import named_components

#: Seed of XXH64 over a shingle.
SEED = 42
#: Differing bits at which fingerprints still link.
RADIUS = 3
#: Words in a shingle.
SHINGLE = 3
#: Rows of one bucket that one task compares; larger buckets are cut into chunk pairs.
BUCKET = 4096
#: Shingle hashes counted at a time, so that a very long text stays in bounded memory.
SLICE = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles in order, a bounded number at a time.

    Words are what lies between ASCII white space, A-Z in lower case; fewer words than
    ``width`` are one shingle, and no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    for i in range(0, len(starts), SLICE):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + SLICE], stops[i : i + SLICE])], dtype="<u8")


def majority(parts: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 where it has no words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, text_key) with the fingerprint as a signed long; no shuffle.

    A null or empty text, or one of white space alone, has fingerprint 0. text_key is
    xxhash64 of the text: with the identifier it tells rows apart that share one.
    """
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints), batch.column(2)], schema=out)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "doc_id long, fp long, text_key long")


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of every pair of the radius + 2 blocks that 64 bits are cut into."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit j of word w in row i is bit i of print 64 w + j."""
    words = -(-len(prints) // 64)
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((words * 64, 64), dtype=np.uint8)
    padded[: len(prints)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8").reshape(64, words)


def near_pairs(prints: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS, slice_words: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (q, i), low[q] <= i < high[q], whose prints differ in ``radius`` bits or fewer."""
    found = list(near_pair_slices(prints, low, high, radius, slice_words))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([i for _, i in found])


def near_pair_slices(prints: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, slice_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, those of ``slice_words`` machine words at a time.

    The vertical counters have as many planes as the radius has bits, and start so high
    that the radius is the last value before they overflow; ``over`` collects the lanes
    beyond it.
    """
    planes = bit_planes(prints)
    counters = max(1, radius.bit_length())
    start = (1 << counters) - 1 - radius
    busy = np.flatnonzero(high > low)
    first, last = low[busy] >> 6, (high[busy] - 1) >> 6
    words = last - first + 1
    ends = np.cumsum(words)
    begin = 0
    while begin < len(busy):
        base = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + slice_words, side="right")))
        n = words[begin:end]
        query = np.repeat(busy[begin:end], n)
        word = np.repeat(first[begin:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        count = [np.full(len(query), _ONES if start >> p & 1 else 0, dtype=np.uint64) for p in range(counters)]
        own = prints[query]
        # Lanes outside the range of the query count as beyond the radius from the start.
        lane = word << 6
        over = ~_lanes(np.clip(low[query] - lane, 0, 64), np.clip(high[query] - lane, 0, 64))
        for i in range(0, 64, 2):
            a = planes[i, word] ^ (np.uint64(0) - ((own >> np.uint64(i)) & np.uint64(1)))
            b = planes[i + 1, word] ^ (np.uint64(0) - ((own >> np.uint64(i + 1)) & np.uint64(1)))
            # Carry-save: two differences and the lowest plane make one plane and one carry.
            half = count[0] ^ a
            carry = (count[0] & a) | (half & b)
            count[0] = half ^ b
            for p in range(1, counters):
                count[p], carry = count[p] ^ carry, count[p] & carry
            over |= carry
            if i % 8 == 6:
                alive = np.flatnonzero(over != _ONES)
                if len(alive) < 0.8 * len(over):
                    query, word, own, over = (x[alive] for x in (query, word, own, over))
                    count = [c[alive] for c in count]
                    if not len(query):
                        break
        hit = np.flatnonzero(over != _ONES)
        if len(hit):
            lanes = np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(lanes)
            yield query[hit][at], (word[hit][at] << 6) + bit
        begin = end


def _lanes(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Words whose bits from head up to tail are set."""
    below = np.where(tail >= 64, _ONES, (np.uint64(1) << np.minimum(tail, 63).astype(np.uint64)) - np.uint64(1))
    under = np.where(head >= 64, _ONES, (np.uint64(1) << np.minimum(head, 63).astype(np.uint64)) - np.uint64(1))
    return below & ~under


def _compare(radius: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    keys = ["mask", "bits", "chunk_a", "chunk_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, 1 << 15):
            key = [part.column(k).to_numpy() for k in keys]
            starts = group_starts(key)
            stops = np.append(starts[1:], part.num_rows)
            chunk = part.column("chunk").to_numpy()
            prints = part.column("fp").to_numpy().view(np.uint64)
            node = part.column("node").to_numpy()
            size = stops - starts
            row = np.arange(part.num_rows)
            high = np.repeat(stops, size)
            low = row + 1
            # In a task of two chunks (a < b) only rows of a ask, and only rows of b are asked.
            cross = key[2] != key[3]
            if cross.any():
                in_a = chunk == key[2]
                n_a = np.add.reduceat(in_a.astype(np.int64), starts)
                low = np.where(cross, np.repeat(starts + n_a, size), low)
                high = np.where(cross & ~in_a, low, high)
            u, v = near_pairs(prints, low, high, radius)
            label = spanning_labels(part.num_rows, u, v)
            moved = np.flatnonzero(label != row)
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], schema=out)

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """A spanning set of links (u, v) over rows (fp, node) with distinct fp, for a small radius.

    Every pair of fingerprints at ``radius`` bits or fewer is connected by returned links.
    """
    keyed = prints.select(
        "fp",
        "node",
        F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("bits")) for i, m in enumerate(masks(radius))])).alias("k"),
    ).select("k.mask", "k.bits", "fp", "node")
    tasks = chunk_pairs(keyed, ["mask", "bits"], "fp", bucket)
    keys = ["mask", "bits", "chunk_a", "chunk_b"]
    return (
        tasks.repartition(*keys)
        .sortWithinPartitions(*keys, "chunk", "node")
        .select(*keys, "chunk", "fp", "node")
        .mapInArrow(_compare(radius), "u long, v long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id, text_key), one per row of ``docs``.

    component_id is the smallest doc_id, other than null, reachable over links, itself
    included (null where there is none). Links run between fingerprints, so rows with null
    or equal ids link like any other. Texts without words all have fingerprint 0. Repeated
    rows are returned as often as they occur; an empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    each = store(fingerprints(docs, id_col, text_col), "prints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    links = near_links(distinct.select("fp", F.col("fp").alias("node")), radius)
    return each.join(named_components(distinct, "fp", links), "fp", "left").select("doc_id", "fp", "component_id", "text_key")
