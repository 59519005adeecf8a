"""Exact deduplication by a tree merge of sorted digest runs.

Each task folds its rows into sorted runs of (digest, byte length, identifier to keep,
copies). A run is one row that holds its records as bytes, so a shuffle moves whole runs
and keeps their order. Slots then exchange runs in rounds: in round k a slot cuts its run
into ``fan_in`` runs by the k-th base-``fan_in`` digit of each digest's final slot and sends
each to the slot that differs from it in that digit alone; what arrives is merged with a
heap, equal digests folded. With a fan-in of two this is the binomial exchange of a
hypercube; sixteen does four of its rounds in one, so that the distinct digests cross the
network once where they would cross it four times. A text with a third of all rows is one
record per task before the first exchange, and no slot ever gathers more than its share of
distinct digests.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, texts_of

#: Slots that trade runs with one another in one round.
FAN_IN = 16
#: Records that a task folds before it closes a run, and records of a run's row at most.
RUN = 200_000
#: A record of a run; has_keep tells a null identifier from any number.
RECORD = np.dtype([("digest", "V32"), ("n_bytes", "<i8"), ("keep_id", "<i8"), ("has_keep", "?"), ("group_size", "<i8")])


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest binary, n_bytes, text_key) of the normalised texts; no shuffle.

    text_key is xxhash64 of the text as it stands: with the identifier it tells rows apart
    that share one.
    """
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("text_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), batch.column(2)],
                schema=out,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).mapInArrow(run, "doc_id long, digest binary, n_bytes long, text_key long")


def _better(a: int | None, b: int | None, largest: bool) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


#: A record in Python: (digest, n_bytes, keep_id, group_size).
_Record = tuple[bytes, int, int | None, int]


def pack_run(records: list[_Record]) -> bytes:
    """The bytes of a run."""
    out = np.zeros(len(records), dtype=RECORD)
    if records:
        digest, n_bytes, keep, size = zip(*records)
        out["digest"] = np.frombuffer(b"".join(digest), dtype="V32")
        out["n_bytes"], out["group_size"] = n_bytes, size
        out["has_keep"] = [k is not None for k in keep]
        out["keep_id"] = [k or 0 for k in keep]
    return out.tobytes()


def unpack_run(data: bytes) -> Iterator[_Record]:
    """Records of a run, a bounded number of them at a time."""
    rows = np.frombuffer(data, dtype=RECORD)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        digests = part["digest"].tobytes()
        for k, (n, keep, has, size) in enumerate(zip(*(part[c].tolist() for c in ("n_bytes", "keep_id", "has_keep", "group_size")))):
            yield digests[32 * k : 32 * k + 32], n, keep if has else None, size


def merge_runs(runs: Iterable[Iterator[_Record]], largest: bool) -> Iterator[_Record]:
    """Merge sorted runs; records are one only if whole digests and byte lengths agree."""
    last: _Record | None = None
    for record in heapq.merge(*runs, key=lambda r: r[:2]):
        if last is not None and last[:2] == record[:2]:
            last = (*last[:2], _better(last[2], record[2], largest), last[3] + record[3])
        else:
            if last is not None:
                yield last
            last = record
    if last is not None:
        yield last


def _home(digest: bytes, slots: int) -> int:
    """The slot in which a digest ends."""
    return int.from_bytes(digest[:6], "big") % slots


class _Outbox:
    """Runs to the slots that one slot trades with in a round, sent when they reach RUN records."""

    def __init__(self, slot: int, slots: int, fan_in: int, place: int) -> None:
        self.slot, self.slots, self.fan_in, self.place = slot, slots, fan_in, place
        self.held: dict[int, list[_Record]] = {}

    def add(self, record: _Record) -> pa.RecordBatch | None:
        """Take a record; a full run comes out."""
        digit = _home(record[0], self.slots) // self.place % self.fan_in
        to = self.slot + (digit - self.slot // self.place % self.fan_in) * self.place
        run = self.held.setdefault(to, [])
        run.append(record)
        return self._send(to) if len(run) >= RUN else None

    def _send(self, to: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([pack_run(self.held.pop(to))], pa.binary())], names=["slot", "run"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The runs that are left."""
        for to in list(self.held):
            yield self._send(to)

    def send(self, records: Iterable[_Record]) -> Iterator[pa.RecordBatch]:
        """Runs of sorted records, all of them."""
        for record in records:
            if full := self.add(record):
                yield full
        yield from self.rest()


def _leaves(slots: int, fan_in: int, largest: bool):
    """Sorted runs of one task, equal digests folded, cut for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % slots
        held: dict[tuple[bytes, int], tuple[int | None, int]] = {}
        for batch in batches:
            for doc_id, digest, n_bytes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                old = held.get((digest, n_bytes))
                held[digest, n_bytes] = (doc_id, 1) if old is None else (_better(old[0], doc_id, largest), old[1] + 1)
            if len(held) >= RUN:
                yield from _Outbox(slot, slots, fan_in, 1).send((*k, *held[k]) for k in sorted(held))
                held = {}
        yield from _Outbox(slot, slots, fan_in, 1).send((*k, *held[k]) for k in sorted(held))

    return run


def _exchange(slots: int, fan_in: int, place: int, largest: bool):
    """Merge the runs that a slot received and cut the result for the round of ``place``.

    In the last round (``place`` reaches the number of slots) the records come out as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        received: dict[int, list[bytes]] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                received.setdefault(slot, []).append(data)
        for slot in sorted(received):
            merged = merge_runs([unpack_run(data) for data in received.pop(slot)], largest)
            if place < slots:
                yield from _Outbox(slot, slots, fan_in, place).send(merged)
            else:
                while rows := list(islice(merged, RUN)):
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "n_bytes", "keep_id", "group_size"])

    return run


def merge_tree(each: DataFrame, leaves: int, fan_in: int = FAN_IN, largest: bool = True) -> DataFrame:
    """Rows (digest, n_bytes, keep_id, group_size), one per distinct digest of ``each``.

    A slot holds the packed runs it received in a round: its share of the distinct digests,
    about 60 bytes each; more ``leaves`` make the shares smaller.
    """
    rounds = max(1, math.ceil(math.log(max(2, leaves), fan_in) - 1e-9))
    slots = fan_in**rounds
    runs = each.select("doc_id", "digest", "n_bytes").mapInArrow(_leaves(slots, fan_in, largest), "slot int, run binary")
    for k in range(1, rounds + 1):
        last = k == rounds
        schema = "digest binary, n_bytes long, keep_id long, group_size long" if last else "slot int, run binary"
        runs = runs.repartition(min(slots, max(leaves, fan_in)), "slot").mapInArrow(_exchange(slots, fan_in, fan_in**k, largest), schema)
    return runs


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, digest, text_key), one per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (the smallest if ``largest`` is false).
    Rows that repeat both text and doc_id are all returned and all kept with that id;
    a null doc_id stays only if its whole group has none. An empty table gives no rows.
    """
    each = store(digests(docs, id_col, text_col), "digests")
    groups = store(merge_tree(each, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in, largest).where("group_size > 1"), "groups")
    return each.join(groups, ["digest", "n_bytes"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
        "text_key",
    )
