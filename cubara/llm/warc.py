"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent frames of several records each, followed by a
skippable frame with the record index (record id -> frame, offset in the frame's
content, length) and the footer seek table of the public seekable format (a
skippable frame with the compressed and plain size of every frame, then the
number of frames, a descriptor and the magic number). A record is read by
decompressing the one frame that holds it.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import shared_dir

# Fixed values of the formats.
SKIPPABLE, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A51, b"\xb1\xea\x92\x8f"
FRAME_BYTES, BUNDLE_BYTES, LEAST, DATE = 256 << 10, 32 << 20, 100, "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names the response with an equal one."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return "urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id}"))


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC headers, HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Records on their way into a file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.held, self.size, self.done, self.frame_bytes = [], 0, 0, frame_bytes

    def add(self, name: int | None, data: bytes) -> None:
        self.index.append((name, len(self.table), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            frame = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(plain)
            self.frames.append(frame)
            self.table.append((len(frame), len(plain)))
            self.done += len(frame)
            self.held, self.size = [], 0

    def finish(self) -> bytes:
        """The file without the seekable magic number, which the writer appends."""
        self.end_frame()
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        seek = b"".join(struct.pack("<II", c, p) for c, p in self.table) + struct.pack("<IB", len(self.table), 0)
        return b"".join(self.frames) + struct.pack("<II", INDEX_FRAME, len(index)) + index + struct.pack("<II", SKIPPABLE, len(seek) + 4) + seek


class Reader:
    """Random access to a bundle's records, from its footer."""

    def __init__(self, data: bytes):
        if data[-4:] != SEEKABLE:
            raise ValueError("no seekable bundle")
        n, _ = struct.unpack_from("<IB", data, len(data) - 9)
        at = len(data) - 9 - 8 * n
        sizes = list(struct.iter_unpack("<II", data[at : at + 8 * n]))
        self.data, self.starts = data, [0]
        for c, _ in sizes:
            self.starts.append(self.starts[-1] + c)
        magic, length = struct.unpack_from("<II", data, self.starts[-1])
        if magic != INDEX_FRAME:
            raise ValueError("no record index")
        self.index = [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[self.starts[-1] + 8 : self.starts[-1] + 8 + length]))]
        self.open: tuple[int, bytes] = (-1, b"")

    def get(self, place: tuple) -> bytes:
        """The record of an index entry."""
        _, frame, offset, length = place
        if self.open[0] != frame:
            self.open = frame, zstandard.ZstdDecompressor().decompress(self.data[self.starts[frame] : self.starts[frame + 1]])
        return self.open[1][offset : offset + length]


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the smallest page_id of equal payloads of at least `least` bytes is referred to by the others.

    A row with the smallest id itself, a null id in such a group and every row
    of a smaller payload are responses; repeated rows with the smallest id are
    all responses.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Digests and ids alone are grouped; combined before the shuffle, so a page copied without end is one row a task.
    first = page.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return page.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write all pages as bundles to `path` (any Hadoop file system). Null html is an empty payload; an empty table gives no bundle."""

    def run(batches):
        bundle, schema = Bundle(frame_bytes), pa.schema([("value", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for page_id, url, source, digest, refers in zip(*(c.to_pylist() for c in some.columns)):
                    bundle.add(page_id, record(page_id, url, source.encode(), digest, refers))
                    if bundle.done >= bundle_bytes:
                        yield pa.RecordBatch.from_pydict({"value": [bundle.finish()]}, schema=schema)
                        bundle = Bundle(frame_bytes)
        if bundle.index:
            yield pa.RecordBatch.from_pydict({"value": [bundle.finish()]}, schema=schema)

    # The text writer puts a row's bytes, then the separator: with one row a file and the magic number as the
    # separator, files are complete bundles, on any file system and with Spark's commit.
    rows = revisits(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE.decode("latin-1")).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """One row per record in the bundles under path: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset.

    A response's figures are those of the payload that was read (one whose
    digest differs from its header raises an error); a revisit's, of the
    headers that stand for the full payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = Reader(data), []
                for place in reader.index:
                    warc, http, payload = parse(reader.get(place))
                    digest = warc["WARC-Payload-Digest"].partition(":")[2]
                    if warc["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path_}: record {place} doesn't have its digest")
                    size = len(payload) if warc["WARC-Type"] == "response" else int(http["Content-Length"])
                    rows.append((place[0], size, digest, warc["WARC-Type"], int(warc["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in warc else None, path_.rpartition("/")[2], place[1], place[2]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame long, offset long")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as bundles (to the shared folder if path is None) and read them back: see write_warc and read_warc."""
    path = path or shared_dir(pages.sparkSession) + "/warc"
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
