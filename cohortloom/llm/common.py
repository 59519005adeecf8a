"""Helpers shared by the training-data operators: reading, storing, grouping, links.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every
executor shares, so a lost executor never loses a finished step.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attribute under which a stored table remembers its own path.
_PATH = "_loom_path"
_left_over: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in a local session without any.

    On a cluster executors would not see a temporary folder of the driver, so there the
    setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"
    if not _left_over:
        atexit.register(_remove_left_over, spark)
    _left_over.add(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _left_over.discard(path)


def _remove_left_over(spark: SparkSession) -> None:
    try:
        for path in list(_left_over):
            _remove(spark, path)
    except Exception:  # the driver's JVM may have gone first
        pass


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def share_file(spark: SparkSession, data: bytes, name: str) -> None:
    """Write a small file into the shared folder and have every executor fetch it once.

    Tasks find it at ``SparkFiles.get(name)``; an executor that starts later fetches it too.
    """
    path = new_path(spark, "files")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(at.toString())


def release(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    if path := getattr(df, _PATH, None):
        _remove(df.sparkSession, path)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column of an Arrow batch as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def spans_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``limit`` or hold one item."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int) -> Iterator[pa.Table]:
    """Regroup key-sorted batches into tables that never split a group.

    Each table has ``target`` rows or more (the last may have fewer) and ends at the
    end of a group. Memory is ``target`` rows plus one group, whose size the callers
    bound before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        full = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(full.num_rows, dtype=bool)
        for k in keys:
            values = full.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            cut = int(cuts[-1])
            yield full.slice(0, cut)
            full = full.slice(cut)
        held, rows = full.to_batches(), full.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Indices at which a new group of equal neighbouring keys begins."""
    change = np.ones(len(columns[0]), dtype=bool)
    if len(change):
        change[1:] = False
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def spanning_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` items over the links (u, v)."""
    label = np.arange(n)
    if not len(u):
        return label
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == label).all():
            return label
        label = after


def chunk_pairs(df: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Split groups of over ``most`` rows so that every pair still meets in one task.

    A group of n rows gets c = ceil(n / most) chunks, dealt by the hash of ``by``; a row
    of chunk i goes to the tasks (min(i, j), max(i, j)) of every j below c. Groups of one
    row go. Adds the columns chunk, chunk_a and chunk_b.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    chunks = F.ceil(F.col("group_rows") / F.lit(most)).cast("int")
    return (
        df.join(sizes, keys)
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(F.col(by)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("chunk_a", F.least("chunk", "other"))
        .withColumn("chunk_b", F.greatest("chunk", "other"))
        .drop("group_rows", "chunks", "other")
    )
