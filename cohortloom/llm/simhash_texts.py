"""SimHash near-duplicates at a wide radius, confirmed by the Jaccard likeness of shingles.

Texts of five-word shingle sets with a likeness of 0.8 differ in ten of 64 bits on
average, too many for buckets of untouched blocks. Buckets are shingles instead: in
any order over all shingles, sets of likeness ``least`` or more share one among the first
n - ceil(least n) + 1 of n (prefix filtering). The order is by the number of sets that
hold a shingle, counted over the whole corpus: shingles of one set come first, so a text
whose own words fill its prefix meets nobody, whatever passages it shares.

Inside a bucket fingerprints are compared bit-sliced, as in ``simhash``, with more counter
planes; pairs within the radius, of fitting sizes and with sketches that differ little
enough are confirmed by their whole sets. A sketch holds the parity of the shingles in each
of 2048 slots: sets differ in as many shingles at least as their sketches in bits.

Rounds come first that give each set one chance in each of its buckets, then the lightest
forest of every bucket over what is not yet connected, as long as that connects anything.
The last round compares all pairs that are left, so nothing near is missed, and groups of
copies never pay for their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_pairs, group_starts, release, spanning_labels, store, texts_of, whole_groups
from .components import connected_components, named_components
from .pieces import forget
from .simhash import SEED, majority, near_pair_slices, shingle_hashes

#: Words in a shingle, and Jaccard likeness from which texts link.
SHINGLE, LEAST = 5, 0.8
#: Bits in which fingerprints may differ: at a likeness of 0.8 the mean is 10 and the spread 3.
WIDE = 24
#: Machine words of a sketch.
SKETCH = 32
#: Sets of one bucket that one task compares, and machine words of lanes compared at a time: among
#: near copies every lane of a word is a pair, so these bound what a task holds.
BUCKET, SLICE_WORDS = 2048, 1 << 12
#: Shingles counted together in a task, how often one must occur there, and most of the common ones.
COUNTED, COMMON_IN, MOST_COMMON = 1 << 19, 3, 1 << 16
#: Slots in which shingles meet, for each shuffle partition of the session.
SLOTS = 4


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each slot, as SKETCH longs."""
    odd = (np.bincount((items % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def shingle_set(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes of a text's shingles, and the fingerprint of all of them."""
    parts = list(shingle_hashes(text, width))
    return (np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)), majority(parts)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)))


def _node(s: np.ndarray) -> int:
    """Hash of a whole set: texts of equal sets are one node."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, text_key, node, n, fp, sketch), one per row of ``docs``."""
    names = ["doc_id", "text_key", "node", "n", "fp", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, sizes, prints, sketches = [], [], [], []
            for text in texts_of(batch, "text"):
                s, fp = shingle_set(text, width)
                nodes.append(_node(s))
                sizes.append(len(s))
                prints.append(fp)
                sketches.append(sketch(s).tobytes())
            longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), longs(nodes), pa.array(sizes, pa.int32()), longs(prints), pa.array(sketches, pa.binary())], names=names)

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, node long, n int, fp long, sketch binary")


def shared_shingles(docs: DataFrame, width: int, common: np.ndarray, slots: int) -> DataFrame:
    """Rows (node, item, sets): shingles in several sets, with their number; common ones have none.

    Every shingle meets its equals in a slot. A task sends a slot what it has for it as one row:
    shingles and, two bytes each, the places of their nodes in a small table, so shuffled
    rows stay few and small. Common shingles are known to be shared and are not sent.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[np.ndarray] = []
        nodes: list[int] = []
        size = 0
        for batch in batches:
            for text in texts_of(batch, "text"):
                s, _ = shingle_set(text, width)
                nodes.append(_node(s))
                items.append(s[~_among(s, common)])
                size += len(items[-1])
                if size >= COUNTED or len(nodes) >= 1 << 16:
                    yield sent(items, nodes)
                    items, nodes, size = [], [], 0
        if nodes:
            yield sent(items, nodes)

    def sent(items: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        item, of = np.concatenate(items), np.repeat(np.arange(len(items)), [len(i) for i in items])
        slot = (item % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        item, of, slot = item[order], of[order], slot[order]
        table = np.array(nodes, dtype=np.uint64)
        starts = group_starts([slot])
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(slot))):
            used, place = np.unique(of[a:b], return_inverse=True)
            rows.append((int(slot[a]), item[a:b].tobytes(), place.astype("<u2").tobytes(), table[used].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], names=["slot", "items", "places", "nodes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for slot, items, places, nodes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                table = np.frombuffer(nodes, dtype=np.uint64)
                held.setdefault(slot, []).append((np.frombuffer(items, dtype=np.uint64), table[np.frombuffer(places, dtype="<u2")]))
        for slot in sorted(held):
            parts = held.pop(slot)
            item, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            del parts
            # Most shingles are alone: only the others are put in order with their nodes.
            order = np.argsort(item)
            alone = np.diff(np.append(group_starts([item[order]]), len(item)))
            order = order[np.repeat(alone, alone) > 1]
            item, node = item[order], node[order]
            order = np.lexsort((node, item))
            item, node = item[order], node[order]
            once = group_starts([item, node])  # equal texts are one node
            item, node = item[once], node[once]
            sets = np.diff(np.append(group_starts([item]), len(item)))
            sets = np.repeat(sets, sets)
            at = np.flatnonzero(sets > 1)
            for i in range(0, len(at), 1 << 16):
                k = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(node[k].view(np.int64)), pa.array(item[k].view(np.int64)), pa.array(sets[k])], names=["node", "item", "sets"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts_of(batch, "text"):
                s, _ = shingle_set(text, width)
                found.append((_node(s), s[_among(s, common)]))
            node = np.repeat(np.array([f[0] for f in found], dtype=np.uint64), [len(f[1]) for f in found])
            item = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(item.view(np.int64)), pa.nulls(len(item), pa.int64())], names=["node", "item", "sets"])

    text, schema = docs.select("text"), "node long, item long, sets long"
    rare = text.mapInArrow(pack, "slot int, items binary, places binary, nodes binary").repartition(slots, "slot").mapInArrow(meet, schema)
    return rare.unionAll(text.mapInArrow(known, schema).distinct()) if len(common) else rare


def _among(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(s), dtype=bool)
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s


def prefixes(sets: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """Rows (item, node): the shared shingles of each prefix.

    Shingles of one set are first in the order, then shared ones by their number of sets,
    then common ones, all by hash where equal.
    """
    n = F.col("n")
    length = (n - F.ceil(F.lit(least) * n - F.lit(1e-9)) + 1).cast("int")
    in_order = F.array_sort(F.collect_list(F.struct(F.coalesce("sets", F.lit(1 << 62)).alias("sets"), "item")))
    held = shared.groupBy("node").agg(in_order.alias("items"))
    sizes = sets.select("node", "n").distinct()
    room = F.greatest(length - (n - F.size("items")), F.lit(0))
    return held.join(sizes, "node").select("node", F.explode(F.slice("items", F.lit(1), room.cast("int"))).alias("x")).select("x.item", "node")


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that occur most over all texts, at most MOST_COMMON.

    Tasks count the sets of COUNTED shingles at a time and pass on what occurs COMMON_IN times
    there, so a shingle is counted wherever it is frequent. The order only steers how large
    buckets grow, never what links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in texts_of(batch, "text"):
                parts = list(shingle_hashes(text, width))
                if parts:
                    held.append(np.unique(np.concatenate(parts)))
                    size += len(held[-1])
                if size >= COUNTED:
                    yield folded(held)
                    held, size = [], 0
        if held:
            yield folded(held)

    def folded(held: list[np.ndarray]) -> pa.RecordBatch:
        items, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= COMMON_IN
        return pa.RecordBatch.from_arrays([pa.array(items[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["item", "n"])

    counts = docs.select("text").mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "item").limit(MOST_COMMON).select("item").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def lightest_forest(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of links (u, v) over ``n`` items that connect what all of them do, light ones first."""
    order = np.lexsort((v, u, weight))
    label, live, chosen = np.arange(n), np.arange(len(order)), []
    u, v = u[order], v[order]
    while True:
        live = live[label[u[live]] != label[v[live]]]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(n, len(order))
        np.minimum.at(best, label[u[live]], live)
        np.minimum.at(best, label[v[live]], live)
        pick = np.unique(best[best < len(order)])
        chosen.append(pick)
        label = spanning_labels(n, label[u[pick]], label[v[pick]])[label]


def _candidates(radius: int, least: float, forest: bool):
    """Pairs (u, v) of a bucket's nodes in different components that are near in bits, of
    fitting sizes and near in sketches; with ``forest`` the lightest that connect the rest."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    keys = ["item", "chunk_a", "chunk_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, 1 << 13):
            key = [part.column(k).to_numpy() for k in keys]
            starts = group_starts(key)
            size = np.append(starts[1:], part.num_rows) - starts
            fp, node, n, c, chunk = (part.column(k).to_numpy() for k in ("fp", "node", "n", "component", "chunk"))
            slots = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH)
            group = np.repeat(np.arange(len(starts)), size)
            high = np.repeat(starts + size, size)
            # Rows are in order of chunk and component: a row asks those after its own component.
            runs = np.append(group_starts([*key, chunk, c]), part.num_rows)
            low = np.repeat(runs[1:], np.diff(runs))
            cross = key[1] != key[2]
            if cross.any():
                # In a task of two chunks (a < b) only rows of a ask, and only rows of b are asked.
                in_a = chunk == key[1]
                n_a = np.add.reduceat(in_a.astype(np.int64), starts)
                low = np.where(cross, np.repeat(starts + n_a, size), low)
                high = np.where(cross & ~in_a, low, high)
            # Items of a forest are the components of each bucket.
            place = np.unique(np.stack([group, c]), axis=1, return_inverse=True)[1].reshape(-1)
            held = [np.zeros(0, dtype=np.int64)] * 3
            for u, v in near_pair_slices(fp.view(np.uint64), low, high, radius, SLICE_WORDS):
                fits = (c[u] != c[v]) & (np.minimum(n[u], n[v]) >= least * np.maximum(n[u], n[v]) - 1e-9)
                u, v = u[fits], v[fits]
                bits = np.zeros(len(u), dtype=np.int64)
                for i in range(0, len(u), 1 << 14):
                    k = slice(i, i + (1 << 14))
                    bits[k] = np.bitwise_count(slots[u[k]] ^ slots[v[k]]).sum(axis=1)
                near = bits <= _most_bits(n[u] + n[v], least)
                u, v, bits = u[near], v[near], bits[near]
                if not forest:
                    yield pairs(node, u, v)
                elif len(u):
                    # The forest of a forest and more links is that of all links.
                    u, v, bits = (np.concatenate(x) for x in zip(held, (u, v, bits)))
                    pick = lightest_forest(int(place.max()) + 1, place[u], place[v], bits)
                    held = [u[pick], v[pick], bits[pick]]
            if len(held[0]):
                yield pairs(node, held[0], held[1])

    def pairs(node: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v]))], schema=out)

    return run


def _most_bits(sizes, least: float):
    """Shingles, and so bits of sketches, in which alike sets of so many shingles in all differ at most."""
    return sizes * ((1 - least) / (1 + least)) + 1e-6


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, least: float) -> DataFrame:
    """Links (u, v) of the pairs (u, v) whose whole sets are alike."""
    pairs = store(pairs.distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # One row per set that is compared, its shingles made again from one of its texts.
    keys = sets.select("node", "text_key").join(ends, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    whole = store(_whole_sets(docs.join(keys.select("text_key"), "text_key", "left_semi"), width).dropDuplicates(["node"]), "sets")
    left, right = whole.select(F.col("node").alias("u"), F.col("items").alias("a")), whole.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = both >= F.lit(least) * (F.size("a") + F.size("b") - both) - F.lit(1e-9)
    links = store(pairs.join(left, "u").join(right, "v").where(alike).select("u", "v"), "near")
    release(whole)
    release(pairs)
    return links


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (node, items) of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width)[0] for t in texts_of(batch, "text")]
            nodes = np.array([_node(s) for s in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), _lists([s.view(np.int64) for s in found])], names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items array<long>")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, least: float = LEAST, radius: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, component_id, text_key), one per row of ``docs``.

    Texts link where their fingerprints differ in ``radius`` bits or fewer and their sets of
    ``width``-word shingles have a Jaccard likeness of ``least`` or more. component_id is the
    smallest doc_id, other than null, reachable over links, itself included (null where there
    is none). Texts without words have equal, empty sets; rows with null or equal ids link
    like any other; an empty table gives no rows. text_key is xxhash64 of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    sets = store(shingle_sets(docs, width), "sets")
    shared = shared_shingles(docs, width, common_shingles(docs, width), SLOTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    posted = store(prefixes(sets, shared, least).join(drawn, "node"), "posted")
    firsts = posted.groupBy("item").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("node", "n", "fp")).alias("first")).where("sets > 1").drop("sets")
    fits = F.least("n", "first.n") >= F.lit(least) * F.greatest("n", "first.n") - F.lit(1e-9)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= radius
    stars = posted.drop("sketch").join(firsts, "item").where("node <> first.node").where(near & fits)
    links = _linked(stars.select(F.col("first.node").alias("u"), F.col("node").alias("v")), docs, sets, width, least)
    forest = True
    while True:
        rest = _rest(posted, connected_components(links), radius, least, forest, bucket)
        more = _linked(rest, docs, sets, width, least)
        links = links.unionByName(more)
        if not forest:
            break
        forest = not more.isEmpty()
    least_id = sets.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    return sets.select("doc_id", "node", "text_key").join(named_components(least_id, "node", links), "node").select("doc_id", "component_id", "text_key")


def _rest(posted: DataFrame, of_node: DataFrame, radius: int, least: float, forest: bool, bucket: int) -> DataFrame:
    """Candidate pairs of every bucket with nodes of several components."""
    keys = ["item", "chunk_a", "chunk_b"]
    placed = posted.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("item").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("item")
    return (
        chunk_pairs(placed.join(mixed, "item"), ["item"], "node", bucket)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "chunk", "component", "node")
        .select(*keys, "chunk", "component", "node", "n", "fp", "sketch")
        .mapInArrow(_candidates(radius, least, forest), "u long, v long")
    )
