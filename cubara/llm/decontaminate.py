"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of `window` consecutive words (a shorter item is
one window). A window is a set of shingles; the join asks for windows that a
document contains whole, so of a window's shingles, ordered by rarity, a prefix
of one shingle is all that has to be joined: a document without the rarest one
doesn't contain the window. A hit on it says where in the document the window
would lie (positional bound), the document must have enough words before and
after it (length bound), and what is left is verified word by word.

Words are compared by their 64-bit hashes. The windows are split into blocks of a
bounded size by a hash of the item. Each block is one broadcast, which a worker
makes into flat arrays once; documents are read against one block after another,
and their hits are merged. Usually there is one block and no merge or shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import map_batches, utf8

WINDOW, SHINGLE, BLOCK_BYTES = 13, 3, 8 << 20
#: Bits of the filter before the table of keys.
_FILTER = 22
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, hits array<struct<start:int,stop:int>>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words of digits, letters a to z and anything beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys the different ones, and where each one's begin, with the end."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.append(first, len(keys))


class Windows:
    """The windows of some items as flat arrays, ready to be looked up."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.items = [str(i) for i, _ in items]
        texts = [words(t) for _, t in items]
        counts = np.array([len(t) for t in texts], np.int64)
        self.flat = hashed([w for t in texts for w in t])
        ends = np.cumsum(counts)
        begins = ends - counts
        #: (words of a window, of its shingles) -> keys, where their entries begin, and by entry: place of the shingle, begin of the window in flat, where its owners begin and end.
        self.tables: list[tuple] = []
        for size in np.unique(np.minimum(counts, window)).tolist():
            n = min(SHINGLE, size)
            if not n:
                continue
            mine = np.flatnonzero(np.minimum(counts, window) == size)
            each = counts[mine] - size + 1
            starts = np.repeat(begins[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            owner = np.repeat(mine, each)
            # Equal windows are one, with all their owners.
            o = np.lexsort((owner, whole := _rolled(self.flat, size)[starts]))
            whole, starts, owner = whole[o], starts[o], owner[o]
            new = np.concatenate(([True], (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])))
            whole, starts, owner = whole[new], starts[new], owner[new]
            different, at = _groups(whole)
            first = starts[at[:-1]]
            # The prefix: the window's shingle that is rarest among these windows' items.
            shingles = _rolled(self.flat, n)
            _, of, times = np.unique(shingles, return_inverse=True, return_counts=True)
            place, least = np.zeros(len(first), np.int64), times[of[first]]
            for k in range(1, size - n + 1):
                now = times[of[first + k]]
                place[now < least] = k
                least = np.minimum(least, now)
            keys = shingles[first + place]
            o = np.argsort(keys, kind="stable")
            keys, begin = _groups(keys[o])
            filter_ = np.zeros(1 << _FILTER, bool)
            filter_[keys >> np.uint64(64 - _FILTER)] = True
            self.tables.append((size, n, filter_, keys, begin, place[o], first[o], at[:-1][o], at[1:][o], owner))

    def find(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged ranges of words inside occurrences, and the items with occurring windows."""
        h = hashed(tokens)
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        rolled = {n: _rolled(h, n) for n in {t[1] for t in self.tables}}
        for size, n, filter_, keys, begin, place, first, owners_from, owners_to, owner in self.tables:
            at = np.flatnonzero(filter_[rolled[n] >> np.uint64(64 - _FILTER)])
            slot = np.searchsorted(keys, rolled[n][at])
            slot[slot == len(keys)] = 0
            good = keys[slot] == rolled[n][at]
            at, slot = at[good], slot[good]
            times = begin[slot + 1] - begin[slot]
            entry = np.repeat(begin[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            start = np.repeat(at, times) - place[entry]
            inside = (start >= 0) & (start + size <= len(h))
            entry, start = entry[inside], start[inside]
            for k in range(size):
                same = self.flat[first[entry] + k] == h[start + k]
                entry, start = entry[same], start[same]
            spans += [(a, a + size) for a in start.tolist()]
            for e in set(entry.tolist()):
                owners.update(owner[owners_from[e] : owners_to[e]].tolist())
        return merged(spans), sorted({self.items[o] for o in owners})


_built: dict[tuple, Windows] = {}


def _index(name: tuple, sent, window: int) -> Windows:
    """The worker's index of a block: the last one is kept for its next tasks."""
    if name not in _built:
        _built.clear()
        _built[name] = Windows(sent.value, window)
    return _built[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (merged word ranges, end excluded), items (ids as sorted strings).

    Null and wordless texts have no words and no hits; items without words have
    no windows; items with equal texts are all named; a null item id is left
    out. Rows stay as they are, repeated ids and null ones too: hits of several
    blocks are merged by id and text. Texts are read whole, one at a time. Other
    columns are not looked at, whatever their names. An empty benchmark gives no
    hits, an empty table no rows.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    blocks = 1 + int(size) // block_bytes
    if blocks > 1:
        thin = thin.withColumn("key", F.xxhash64("text"))
    schema = SCHEMA + (", key long" if blocks > 1 else "")

    name = uuid.uuid4().hex

    def against(block: int) -> DataFrame:
        # One block holds block_bytes on average: what is sent has a bound whatever the benchmark's size.
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r[0], r[1].encode() if r[1] is not None else None) for r in part.toLocalIterator()])

        def make():
            index = _index((name, block), sent, window)

            def each(b: pa.RecordBatch) -> dict:
                tokens = [words(t) for t in utf8(b.column(1))]
                found = [index.find(t) for t in tokens]
                return {"doc_id": b.column(0), "n_words": [len(t) for t in tokens], "hits": [[{"start": a, "stop": z} for a, z in h] for h, _ in found], "items": [i for _, i in found]} | ({"key": b.column(2)} if blocks > 1 else {})

            return each

        return map_batches(thin, make, schema)

    if blocks == 1:
        return against(0)
    # Every row comes from the first block once, so that counts the rows of an id and text.
    every = against(0).withColumn("first", F.lit(1))
    for block in range(1, blocks):
        every = every.union(against(block).where(F.size("items") > 0).withColumn("first", F.lit(0)))
    lists = every.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("first").cast("int").alias("rows"))
    join = F.expr(
        "aggregate(array_sort(hits), cast(array() as array<struct<start:int,stop:int>>), (done, x) -> "
        "if(size(done) > 0 and x.start <= done[size(done) - 1].stop, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('start', done[size(done) - 1].start, 'stop', greatest(done[size(done) - 1].stop, x.stop)))), "
        "concat(done, array(x))))"
    )
    merged_rows = lists.withColumn("hits", join)
    return merged_rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).select("doc_id", "n_words", "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: at least one hit word in every `share` words. See find_windows for nulls, ties and empty tables."""
    found = find_windows(docs, benchmark, window, **names)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
