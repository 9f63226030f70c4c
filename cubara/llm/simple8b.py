"""Token ids in files of Simple-8b words.

File (one per range of documents, little-endian):
  magic "C8B1" | block*  | tail | 4 bytes written by the writer (TAIL_MARK)
  block: up to BLOCK ids in 64-bit words, each coded by itself.
  tail: block table (u64 byte offset, u32 words, u32 ids a block), document table
        (i64 doc_id, u8 null flag, u64 ids a document), then u64 n_blocks,
        u64 n_docs, u64 byte offset of the tail.
A word's top 4 bits select how many ids of how many bits the other 60 hold
(SELECTORS); selector 0 is the escape: the whole next word is one id. Blocks
start at known offsets and hold whole words, so any of them decodes by itself,
with all words of one selector at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import in_order, shared_dir
from cubara.llm.tokens import encoder

#: Fixed values of the format: (ids a word, bits an id) by selector; 0 is the escape.
SELECTORS = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
MAGIC, TAIL_MARK, BLOCK = b"C8B1", b"8b1\n", 4096
#: Ids after which a file is closed: what a task holds, and a file's size.
FILE_IDS = 4 << 20


_WIDTHS = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least."""
    if values.max() < 1 << 16:
        return _WIDTHS[values]
    out, rest = np.ones(len(values), np.uint8), values
    for base in range(0, 64, 16):
        now = rest > 0
        out[now] = np.maximum(out[now], _WIDTHS[rest[now] & np.uint64(0xFFFF)] + base)
        rest = rest >> np.uint64(16)
    return out


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each position, the selector of the most ids that fit a word from there; bits ends with 60 times 255."""
    n = len(bits) - 60
    chosen = np.zeros(n, np.uint8)
    best, top, size = {1: bits}, bits, 1
    while size < 60:  # best[c]: the largest of c lengths, by doubling
        wide = min(60, size * 2)
        top = np.maximum(top[: len(bits) - wide + 1], top[wide - size : len(bits) - size + 1])
        best[wide] = top
        size = wide
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, width = SELECTORS[s]
        half = max(c for c in best if c <= count)
        top = best[half][:n] if half == count else np.maximum(best[half][:n], best[half][count - half : count - half + n])
        chosen[top <= width] = s
    return chosen


def encode(values: np.ndarray) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The words of all blocks, and (byte offset, words, ids) of each block."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return b"", []
    heads = np.arange(0, n, BLOCK)
    ends = np.minimum(heads + BLOCK, n)
    # What lies beyond a block's end never fits, so no word spans two blocks.
    bits = np.full((len(heads), BLOCK + 60), 255, np.uint8)
    last = n - int(heads[-1])
    lengths = _lengths(values)
    bits[:-1, :BLOCK] = lengths[: int(heads[-1])].reshape(-1, BLOCK)
    bits[-1, :last] = lengths[int(heads[-1]) :]
    chosen = _choices(np.append(bits.ravel(), np.full(60, 255, np.uint8))).reshape(len(heads), -1)[:, :BLOCK].ravel()[:n]
    step = np.array([c for c, _ in SELECTORS], np.int64)[chosen]
    # Blocks are walked side by side: each step takes one word from every block; the last, shorter one waits at its end.
    step = np.append(step, 0)
    at, steps = heads.copy(), []
    while True:
        steps.append(at)
        at = np.minimum(at + step[at], ends)
        if (at == ends).all():
            break
    walk = np.array(steps)
    first = np.ones(walk.shape, bool)
    first[1:] = walk[1:] > walk[:-1]
    first &= walk < ends
    starts = np.sort(walk[first])
    picked = chosen[starts]
    size = 1 + (picked == 0)
    place = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(picked):
        mine = np.flatnonzero(picked == s)
        count, width = SELECTORS[s]
        if s == 0:
            words[place[mine] + 1] = values[starts[mine]]
            continue
        word = np.full(len(mine), int(s) << 60, np.uint64)
        for k in range(count):
            word |= values[starts[mine] + k] << np.uint64(k * width)
        words[place[mine]] = word
    of = starts // BLOCK
    used = np.bincount(of, weights=size, minlength=len(heads)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(used)))[:-1] * 8
    return words.astype("<u8").tobytes(), list(zip(offsets.tolist(), used.tolist(), (ends - heads).tolist()))


def decode(data: bytes | memoryview, n_ids: int) -> np.ndarray:
    """The ids of one block, or of several whole ones together."""
    words = np.frombuffer(data, "<u8")
    selector = (words >> np.uint64(60)).astype(np.uint8)
    if not selector.all():  # an escape's second word has no selector, whatever its bits
        raw, i = [], 0
        zero = np.flatnonzero(selector == 0).tolist()
        for z in zero:
            if z >= i:
                raw.append(z + 1)
                i = z + 2
        selector[raw] = 255
    counts = np.array([c for c, _ in SELECTORS] + [0] * (256 - len(SELECTORS)), np.int64)[selector]
    place = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(place[-1], np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 255:
            continue
        count, width = SELECTORS[s]
        if s == 0:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[place[mine] + k] = (words[mine] >> np.uint64(k * width)) & mask
    if len(out) != n_ids:
        raise ValueError(f"{len(out)} ids where the table says {n_ids}")
    return out


def pack_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file without TAIL_MARK. docs: (doc_id, ids as little-endian u32 bytes), in their order."""
    ids = np.frombuffer(b"".join(b for _, b in docs), "<u4")
    body, blocks = encode(ids)
    tail = b"".join(struct.pack("<QII", len(MAGIC) + o, w, n) for o, w, n in blocks) + b"".join(struct.pack("<qBQ", d or 0, d is None, len(b) // 4) for d, b in docs)
    return MAGIC + body + tail + struct.pack("<QQQ", len(blocks), len(docs), len(MAGIC) + len(body))


def file_tables(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """A whole file's block table and document table."""
    if data[:4] != MAGIC or data[-4:] != TAIL_MARK:
        raise ValueError("no file of token ids")
    n_blocks, n_docs, tail = struct.unpack_from("<QQQ", data, len(data) - 28)
    blocks = list(struct.iter_unpack("<QII", data[tail : tail + 16 * n_blocks]))
    at = tail + 16 * n_blocks
    return blocks, list(struct.iter_unpack("<qBQ", data[at : at + 17 * n_docs]))


def read_ids(data: bytes, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n of a file, from the blocks that hold them only."""
    blocks, _ = file_tables(data)
    out, at = [], 0
    for offset, words, count in blocks:
        if at + count > start and at < start + n:
            out.append(decode(data[offset : offset + 8 * words], count)[max(0, start - at) : start + n - at])
        at += count
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Write files of token ids in ascending id order to `path` (any Hadoop file system).

    Null texts are empty, so a document is its end id at least. Repeated rows
    and ties in the id are written each, in the order of a hash of their texts;
    null ids come first. A text of any length is one document, held whole by one
    task. Other columns are not looked at, whatever their names. An empty table
    writes no file with documents.
    """
    ordered = in_order(docs, id_col, text_col)
    end = struct.pack("<I", end_id)

    def run(batches):
        known, held, size = encoder(tokenizer), [], 0
        name = lambda d: pa.RecordBatch.from_pydict({"value": [d]}, schema=pa.schema([("value", pa.binary())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for d, ids in zip(some.column(0).to_pylist(), known.encode_all(some.column(1))):
                    held.append((d, ids + end))
                    size += len(held[-1][1]) // 4
                    if size >= file_ids:
                        yield name(pack_file(held))
                        held, size = [], 0
        if held:
            yield name(pack_file(held))
        pa.default_memory_pool().release_unused()

    # The text writer puts a row's bytes, then lineSep: one row a file makes binary files on any file system, with Spark's commit.
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", TAIL_MARK.decode()).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under path, decoded from their words.

    start counts the ids of all documents before. Files are in the order of
    their first document; of files that begin with the same id, of their names.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def totals(batches):
        for b in batches:
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, docs = file_tables(d)
                yield pa.RecordBatch.from_pydict({"path": [p], "first_null": [bool(docs[0][1])], "first_id": [docs[0][0]], "n": [sum(x[2] for x in docs)]}, schema=pa.schema([("path", pa.string()), ("first_null", pa.bool_()), ("first_id", pa.int64()), ("n", pa.int64())]))

    def rows(batches):
        for b in batches:
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, docs = file_tables(d)
                ids = np.concatenate([decode(d[o : o + 8 * w], n) for o, w, n in blocks]).astype("<u4") if blocks else np.zeros(0, "<u4")
                at = np.concatenate(([0], np.cumsum([n for _, _, n in docs])))
                raw = memoryview(ids).cast("B")
                out = {"path": [p] * len(docs), "doc_id": [None if null else i for i, null, _ in docs], "local": at[:-1], "n_tokens": [n for _, _, n in docs], "ids_crc32": [zlib.crc32(raw[4 * int(a) : 4 * int(z)]) for a, z in zip(at, at[1:])]}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    # A few numbers a file, so one task orders them: 16 MB of ids make one row.
    from pyspark.sql import Window

    before = Window.orderBy(F.col("first_null").desc(), "first_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.mapInArrow(totals, "path string, first_null boolean, first_id long, n long").select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = files.mapInArrow(rows, "path string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "path").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **names) -> DataFrame:
    """Write docs as files of ids (to a folder of the shared place if path is None) and read them back: see write_ids and read_documents."""
    path = path or shared_dir(docs.sparkSession) + "/ids"
    write_ids(docs, path, tokenizer, end_id, **names)
    return read_documents(docs.sparkSession, path)


__all__ = ["decode", "encode", "file_tables", "pack_file", "read_documents", "read_ids", "token_files", "write_ids"]
