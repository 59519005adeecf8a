"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and projecting on principal directions
never lengthens a distance. Vectors are sorted by label and by the grid cells (of width
epsilon) of their leading projections; the order is cut into short intervals, each with
the box its projections fill. Two intervals are joined only if their boxes come within
epsilon, and inside a pair of intervals the join halves both, skipping the halves whose
boxes are farther apart. What is left is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, release, spanning_labels, store, whole_groups
from .components import named_components
from .sampling import bounded_sample

#: Cosine from which vectors of one label link.
THRESHOLD = 0.98
#: Leading principal directions that order the vectors, and those that key interval pairs.
DIMENSIONS, KEYED = 8, 2
#: Vectors that the directions are fitted on, at most.
SAMPLE = 4096
#: Vectors in an interval of the order, and in a leaf of the recursion.
INTERVAL, LEAF = 512, 64
#: Slack for rounding in distances of projections.
SLACK = 1e-6


def unit_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (vec_id, label, raw, usable): raw is the vector as little-endian doubles.

    A vector that is null, empty, zero, or holds null or non-finite components, and one
    without a label, is not usable.
    """
    names = ["vec_id", "label", "raw", "usable"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for scalar in batch.column(2):
                v = None
                if scalar.is_valid and len(scalar) and not scalar.values.null_count:
                    v = scalar.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 becomes 0.0
                    if not np.isfinite(v).all() or not v.any() or not np.isfinite(v @ v) or not v @ v > 0:
                        v = None
                raw.append(None if v is None else v.tobytes())
            label = batch.column(1)
            usable = [r is not None and la.is_valid for r, la in zip(raw, label)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), label, pa.array(raw, pa.binary()), pa.array(usable, pa.bool_())], names=names)

    own = embeddings.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    return own.mapInArrow(run, "vec_id long, label string, raw binary, usable boolean")


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length. All vectors must have one dimension."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(vectors: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> np.ndarray:
    """Leading directions of at most ``sample`` vectors, chosen by the hash of their class.

    Any orthonormal directions give right results; these prune best.
    """
    rows = bounded_sample(vectors, sample, "class").orderBy("class").select("raw").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _matrix([bytes(r.raw) for r in rows])
    x = x - x.mean(axis=0)
    values, vectors_of = np.linalg.eigh(x.T @ x)
    return vectors_of[:, np.argsort(values)[::-1][:dimensions]]


def grid_order(vectors: DataFrame, directions: np.ndarray, epsilon: float, interval: int = INTERVAL) -> DataFrame:
    """Rows (block, seq, label, node, copies, raw, box_low, box_high) in epsilon grid order.

    block numbers the intervals: at most ``interval`` vectors of one label that follow one
    another in the order of label, cells and projections. The box is the interval's.
    """
    k = directions.shape[1]
    cells = [f"c{i}" for i in range(k)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _matrix(batch.column(2).to_pylist()) @ directions
            cell = np.floor(p / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(p), pa.list_(pa.float64())), *[pa.array(cell[:, i]) for i in range(k)]],
                names=["node", "label", "raw", "copies", "at", *cells],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def emit(part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            starts = [0]
            label = part.column("label").to_pylist()
            for i in range(1, part.num_rows):
                if label[i] != label[i - 1] or i - starts[-1] >= interval:
                    starts.append(i)
            stops = starts[1:] + [part.num_rows]
            at = np.array(part.column("at").to_pylist()).reshape(part.num_rows, -1)
            for a, b in zip(starts, stops):
                if b == part.num_rows and not last and b - a < interval:
                    held.append(part.slice(a).combine_chunks().to_batches()[0])
                    return
                rows = part.slice(a, b - a)
                n = rows.num_rows
                low, high = at[a:b].min(axis=0), at[a:b].max(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + blocks] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), *[rows.column(c).combine_chunks() for c in ("label", "node", "copies", "raw")], pa.array([low.tolist()] * n, pa.list_(pa.float64())), pa.array([high.tolist()] * n, pa.list_(pa.float64()))],
                    names=["block", "seq", "label", "node", "copies", "raw", "box_low", "box_high"],
                )
                blocks += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([*held, batch]).combine_chunks()
            held.clear()
            yield from emit(part, False)
        if held:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield from emit(part, True)

    shape = ", ".join(f"{c} int" for c in cells)
    projected = vectors.select("node", "label", "raw", "copies").mapInArrow(project, f"node long, label string, raw binary, copies long, at array<double>, {shape}")
    order = ["label", *cells, F.col("at")[0], "node"]
    return (
        projected.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("label", "node", "copies", "raw", "at")
        .mapInArrow(cut, "block long, seq int, label string, node long, copies long, raw binary, box_low array<double>, box_high array<double>")
    )


def near_blocks(blocks: DataFrame, epsilon: float, keyed: int = KEYED) -> DataFrame:
    """Pairs (a, b), a <= b, of intervals of one label whose boxes come within epsilon.

    Intervals meet under the grid cells that their boxes cover in the ``keyed`` leading
    directions; one side also asks the neighbouring cells, so no near pair is missed.
    """
    cell = lambda side, i, by: (F.floor(F.col(side)[i] / F.lit(epsilon)) + F.lit(by)).cast("int")
    left = right = blocks
    for i in range(keyed):
        left = left.withColumn(f"k{i}", F.explode(F.sequence(cell("box_low", i, 0), cell("box_high", i, 0))))
        right = right.withColumn(f"k{i}", F.explode(F.sequence(cell("box_low", i, -1), cell("box_high", i, 1))))
    keys = ["label", *[f"k{i}" for i in range(keyed)]]
    left = left.select(*keys, F.col("block").alias("a"), F.col("box_low").alias("a_low"), F.col("box_high").alias("a_high"))
    right = right.select(*keys, F.col("block").alias("b"), F.col("box_low").alias("b_low"), F.col("box_high").alias("b_high"))
    gap = "aggregate(sequence(0, size(a_low) - 1), 0D, (s, i) -> s + pow(greatest(a_low[i] - b_high[i], b_low[i] - a_high[i], 0D), 2))"
    near = left.join(right, keys).where("a <= b").where(F.expr(gap) <= F.lit((epsilon + SLACK) ** 2))
    return near.select("a", "b").distinct()


def interval_join(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, threshold: float, epsilon: float, same: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y with cosine of ``threshold`` or more.

    Halves the longer interval again and again and drops pairs whose boxes are over
    epsilon apart. With ``same``, x and y are one interval and only i < j is returned.
    """
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a + 1 and c < a:
            continue
        px, py = at_x[a:b], at_y[c:d]
        gap = np.maximum(0, np.maximum(px.min(axis=0) - py.max(axis=0), py.min(axis=0) - px.max(axis=0)))
        if gap @ gap > (epsilon + SLACK) ** 2:
            continue
        if b - a > leaf and b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        elif d - c > leaf:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
        else:
            u, v = np.nonzero(x[a:b] @ y[c:d].T >= threshold)
            u, v = u + a, v + c
            if same:
                u, v = u[u < v], v[u < v]
            us.append(u)
            vs.append(v)
    if not us:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(us), np.concatenate(vs)


def _join_blocks(directions: np.ndarray, threshold: float, epsilon: float):
    """Links inside pairs of intervals: per vector its number of links and one root to reach."""
    names = ["node", "n_links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["a", "b"], 2048):
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            starts = group_starts([a, b])
            stops = np.append(starts[1:], part.num_rows)
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            x = _matrix(part.column("raw").to_pylist())
            at = x @ directions
            second = part.column("side").to_numpy()
            for lo, hi in zip(starts.tolist(), stops.tolist()):
                same = a[lo] == b[lo]
                mid = hi if same else lo + int((second[lo:hi] == 0).sum())
                c = lo if same else mid
                u, v = interval_join(x[lo:mid], at[lo:mid], x[c:hi], at[c:hi], threshold, epsilon, bool(same))
                if not len(u):
                    continue
                u, v = u, v + (c - lo)
                n = hi - lo
                own = copies[lo:hi]
                links = np.bincount(u, own[v], n) + np.bincount(v, own[u], n)
                label = spanning_labels(n, u, v)
                hit = np.flatnonzero(links)
                ids = node[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[label[hit]])], names=names)

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", interval: int = INTERVAL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``embeddings``.

    Vectors link when their labels are equal and not null and their cosine in double
    precision is ``threshold`` or more. Equal vectors of one label are one vector with
    copies until the end, so a large group of copies costs one comparison; links run
    between such classes, never between ids, so rows with equal or null ids link like any
    other. Vectors that are not usable link with nothing. component_id is the smallest
    vec_id, other than null, of the rows connected, the row itself included; kept is true
    where it is the row's own. An empty table gives no rows. Vectors of different length
    never link.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    epsilon = float(np.sqrt(2 - 2 * threshold))
    each = store(unit_vectors(embeddings, id_col, vector_col, label_col), "vectors")
    # Vectors of another length are of another label.
    named = each.withColumn("label", F.concat_ws(":", F.octet_length("raw"), "label")).withColumn("class", F.when(F.col("usable"), _class_key()))
    classes = named.where("usable").groupBy("class", "label", "raw").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    # Numbers are given once, when the table is written.
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    joined = classes.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("root")).limit(0)
    for (size,) in classes.select(F.octet_length("raw")).distinct().collect():  # one, unless lengths are mixed
        of_size = classes.where(F.octet_length("raw") == size)
        directions = principal_directions(of_size)
        rows = store(grid_order(of_size, directions, epsilon, interval), "order")
        pairs = near_blocks(rows.where("seq = 0").select("block", "label", "box_low", "box_high"), epsilon, min(KEYED, directions.shape[1]))
        tasks = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block"))
        members = (
            tasks.join(rows.select("block", "seq", "node", "copies", "raw"), "block")
            .repartition("a", "b")
            .withColumn("side", (F.col("block") != F.col("a")).cast("int"))
            .sortWithinPartitions("a", "b", "side", "seq")
            .select("a", "b", "side", "node", "copies", "raw")
        )
        found = store(members.mapInArrow(_join_blocks(directions, threshold, epsilon), "node long, n_links long, root long"), "found")
        release(rows)
        joined = joined.unionAll(found)
    counts = joined.groupBy("node").agg(F.sum("n_links").alias("others"))
    components = named_components(classes, "node", joined.select(F.col("node").alias("u"), F.col("root").alias("v")))
    by_class = classes.select("class", "node", "copies").join(counts, "node", "left").join(components, "node").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    # Rows find their class by its digest, not by the vector itself; a row without one has a key of its own.
    alone = F.concat(F.lit("-"), F.xxhash64("vec_id"))
    out = named.select("vec_id", "usable", F.coalesce("class", alone).alias("class")).join(by_class, "class", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _class_key():
    """Digest of label and vector: both have their lengths in front, so none runs into the other."""
    return F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\x00"), F.col("raw")), 256)
