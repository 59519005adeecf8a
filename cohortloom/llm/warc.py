"""WARC archives: write, normalise, index and read back.

Pages are first written as whole-file gzip streams of WARC records, as many crawlers leave
them. The normaliser inflates each such file once, in bounded steps, rewrites every record
as a gzip member of its own, and writes a sidecar index with the place of every member, so
that one record can later be read alone. Archives hold about ARCHIVE_BYTES of payload.
All files go through Spark's readers and writers, so any shared store will do; a task has
the compressed bytes of one archive in memory, never the inflated ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _remove, new_path, release, store

#: Payload bytes that an archive holds, about.
ARCHIVE_BYTES = 128 << 20
#: Bytes of members that the normaliser gathers before it passes them on.
CHUNK = 4 << 20
#: Bytes from which equal payloads are stored once.
LEAST_BYTES = 0
#: Bytes inflated at a time.
STEP = 1 << 16
#: What ends a record, and an empty gzip member, which ends every file.
END_OF_RECORD = b"\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
#: Fixed value: the profile of a revisit record for an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_ID = "<urn:loom:page:{}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record that refers to one; no end mark."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a record's or response's head, names in lower case."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def split_records(data: bytes) -> Iterator[bytes]:
    """Records of a whole gzip stream (of any number of members), end marks included."""
    held, engine, at = bytearray(), zlib.decompressobj(31), 0
    pending = b""
    while True:
        if engine.eof:
            pending = engine.unused_data + pending
            engine = zlib.decompressobj(31)
        if not pending:
            pending = data[at : at + STEP]
            at += STEP
        if not pending:
            break
        held += engine.decompress(pending)
        pending = b""
        begin = 0
        while (head := held.find(b"\r\n\r\n", begin)) >= 0:
            length = re.search(rb"\r\ncontent-length:\s*(\d+)", bytes(held[begin:head]), re.IGNORECASE)
            if length is None:
                raise ValueError("a record has no length")
            end = head + 4 + int(length[1]) + len(END_OF_RECORD)
            if end > len(held):
                break
            yield bytes(held[begin:end])
            begin = end
        del held[:begin]
    if held:
        raise ValueError("the stream ends within a record")


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that holds anything."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        engine, begin, parts = zlib.decompressobj(31), at, []
        while not engine.eof and at < len(data):
            step = view[at : at + STEP]
            parts.append(engine.decompress(step))
            at += len(step)
        if not engine.eof:
            raise ValueError("the file ends within a member")
        at -= len(engine.unused_data)
        if content := b"".join(parts):
            yield begin, at - begin, content


def parse(content: bytes) -> dict:
    """Fields of one record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: int(uri.rpartition(":")[2][:-1]) if uri and uri[-2] != ":" else None
    out = {"page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to"))}
    if fields["warc-type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": payload_digest(payload)}
    else:
        out |= {"payload": None, "payload_bytes": int(headers(http)["content-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    return out


def payloads(pages: DataFrame) -> DataFrame:
    """Rows (page_id, digest, n_bytes): SHA-256 and size of each page's payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))


def revisits(sized: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows (page_id, digest, refers_to) of the payloads that a page of larger id repeats.

    A page is told by its id and payload together, so pages that share an id stay apart.
    """
    each = sized.where(F.col("n_bytes") >= least_bytes)
    groups = each.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return each.join(groups, ["digest", "n_bytes"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_monolithic(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write pages (page_id, url, html) as WARC files, each one gzip stream; their number.

    A null html is an empty payload. Of equal payloads the page of largest id is the
    response. Pages without an id are always responses; rows that repeat page and payload
    are written again, a repeated largest one as response each time. Without pages nothing
    is written.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    sized = store(payloads(pages), "payloads")
    total = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes")).first()
    if not total.rows:
        release(sized)
        return 0
    archives = max(1, -(-int(total.bytes) // archive_bytes))
    again = store(revisits(sized, least_bytes), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            made = [record(i, u, (h or "").encode("utf-8", "surrogatepass"), r) for i, u, h, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(4)], names=["record", "archive"])

    (
        pages.withColumn("digest", F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256))
        .join(again, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to", F.pmod(F.xxhash64("page_id", "url"), F.lit(archives)).cast("int").alias("archive"))
        .mapInArrow(run, "record binary, archive int")
        .repartitionById(archives, F.col("archive"))
        .select(F.col("record").cast("string").alias("value"), "archive")
        .write.partitionBy("archive")
        .option("compression", "gzip")
        .option("lineSep", END_OF_RECORD.decode())
        .text(path)
    )
    release(sized)
    release(again)
    return archives


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Rewrite whole-stream WARC files record by record, with a sidecar index.

    For every archive there are ``archive=N/kind=warc`` (each record a gzip member) and
    ``archive=N/kind=index`` (gzip text: page_id, offset, length, record type of each
    member, by tabs). Both leave the function in chunks, each ended by an empty member,
    which readers pass over and offsets count.
    """
    names = ["data", "archive", "kind", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive, place, seq = batch.column(0)[i].as_py(), 0, 0
                out, lines = bytearray(), []

                def chunk() -> pa.RecordBatch:
                    index = _member("".join(lines).encode())
                    return pa.RecordBatch.from_arrays([pa.array([bytes(out), index], pa.binary()), pa.array([archive] * 2, pa.int32()), pa.array(["warc", "index"]), pa.array([seq] * 2, pa.int32())], names=names)

                for content in split_records(batch.column(1)[i].as_py()):
                    member, found = _member(content), parse(content)
                    lines.append(f"{'' if found['page_id'] is None else found['page_id']}\t{place + len(out)}\t{len(member)}\t{found['record_type']}\n")
                    out += member
                    if len(out) >= CHUNK:
                        yield chunk()
                        place, seq = place + len(out) + len(EMPTY_MEMBER), seq + 1
                        out, lines = bytearray(), []
                yield chunk()

    (
        spark.read.format("binaryFile").load(source)
        .select(F.col("archive").cast("int"), "content")
        .mapInArrow(run, "data binary, archive int, kind string, seq int")
        .select(F.col("data").cast("string").alias("value"), "archive", "kind", "seq")
        .sortWithinPartitions("archive", "kind", "seq")
        .drop("seq")
        .write.partitionBy("archive", "kind")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


def _member(content: bytes) -> bytes:
    """One gzip member."""
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(content) + engine.flush()


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("kind") == kind).select(F.col("archive").cast("int"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, page_id, offset, length, record_type) of the sidecar indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [line.split("\t") for _, _, text in members(data) for line in text.decode().splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(rows), pa.int32()), pa.array([int(r[0]) if r[0] else None for r in rows], pa.int64()), pa.array([int(r[1]) for r in rows], pa.int64()), pa.array([int(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())],
                    names=["archive", "page_id", "offset", "length", "record_type"],
                )

    return _files(spark, path, "index").mapInArrow(run, "archive int, page_id long, offset long, length long, record_type string")


def _places(spark: SparkSession, path: str, wanted: DataFrame | None) -> DataFrame:
    """Rows (places, content): an archive's bytes and the index rows asked of it."""
    index = wanted if wanted is not None else read_index(spark, path)
    places = index.groupBy("archive").agg(F.collect_list(F.struct("page_id", "offset", "length")).alias("places"))
    return _files(spark, path, "warc").join(places.hint("shuffle_hash"), "archive").select("places", "content")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes]]]:
    """(page_id, record) of every place, some at a time: cut out by offset and length, and
    only what was cut out is inflated."""
    for batch in batches:
        for places, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = memoryview(data.as_buffer())
            for i in range(0, len(places), 256):
                yield [(p["page_id"], zlib.decompress(whole[p["offset"] : p["offset"] + p["length"]], 31)) for p in places[i : i + 256]]


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, record binary) of the index rows ``wanted`` (columns of ``read_index``),
    of all of them without it.

    Places are gathered by archive, whose size is bounded, and meet the archive's bytes there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _records(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], names=["page_id", "record"])

    return _places(spark, path, wanted).mapInArrow(run, "page_id long, record binary")


def read_pages(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of the same records,
    parsed where they are read."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _records(batches):
            rows = [parse(r) for _, r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], names=list(kinds))

    return _places(spark, path, wanted).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages, normalise the archives, and return their records as read back.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), one per row of
    ``pages``: every entry of the index with the record that lies at its place. Size and
    digest are those of the full payload, for revisits too. Pages that share an id are told
    by their payloads; pages without an id are responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    whole, path = new_path(spark, "warc-whole"), path or new_path(spark, "warc")
    if not write_monolithic(pages, whole, least_bytes, archive_bytes):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    normalise(spark, whole, path)
    _remove(spark, whole)
    return read_pages(spark, path)
