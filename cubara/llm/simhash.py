"""SimHash near-duplicates by pivot distance tables.

Every distinct 64-bit fingerprint gets a table of Hamming distances to many
reference fingerprints, the pivots. Two fingerprints within r bits differ by at
most r in every distance, so a pair with a larger difference in any coordinate
is discarded; survivors are verified exactly.

Which pairs are looked at follows from the same table. The pivots are: zero, and
for each of BANDS bit ranges several fingerprints with bits in that range only.
The distances to zero and to such a pivot give how many bits of the range lie in
the pivot (`coordinates`), and r differing bits leave all coordinates of at least
BANDS - r ranges as they are. Fingerprints are therefore joined on the
coordinates of every choice of BANDS - r ranges: no link is lost, and no sort of
the whole table against itself is needed.

A join key shared by more than `heavy` fingerprints (a large group of near
copies) isn't paired. Its fingerprints go an exact way without pairs: two
fingerprints link if and only if the balls of radius 1 around them meet (r = 2),
so each sends its 65 ball points, and each point joins all that sent it to the
smallest of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import connected, map_batches, utf8, written

BITS, BANDS, RADIUS, PIVOTS_A_BAND, HEAVY = 64, 5, 2, 14, 32
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLICE = 1 << 14


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned SimHash of a text: ASCII-lower-cased words cut at space and \\t..\\r, XXH64 (seed 42) of space-joined shingles, bits set in over half of them. Null and wordless texts: 0."""
    words = (text or b"").translate(_FOLD).split()  # bytes.split cuts at exactly space and \t \n \v \f \r
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    count, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _SLICE):
        h = b"".join([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE])])
        bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, BITS)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        count += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        count += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def pivots() -> list[list[int]]:
    """The pivots of each band as bit masks: fixed pseudo-random halves of the band's bits."""
    cuts = [BITS * b // BANDS for b in range(BANDS + 1)]
    out = []
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rng = np.random.default_rng(1000 + b)
        masks = {int(sum(1 << int(i) for i in rng.choice(np.arange(lo, hi), (hi - lo + 1) // 2, replace=False))) for _ in range(4 * PIVOTS_A_BAND)}
        out.append(sorted(masks, key=lambda m: xxhash.xxh64_intdigest(m.to_bytes(8, "little")))[:PIVOTS_A_BAND])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fp: Column) -> Column:
    """The pivot table's row: distances to zero, then to every pivot, band by band."""
    far = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("tinyint")
    return F.array(far(0), *(far(p) for band in pivots() for p in band))


def coordinates(table: str, band: int) -> list[Column]:
    """How many of the fingerprint's bits lie in each pivot of the band, from the distances alone: (d0 + |p| - dp) / 2."""
    d, at = F.col(table), 1 + band * PIVOTS_A_BAND
    return [F.shiftright(d[0].cast("int") + F.lit(p.bit_count()) - d[at + i].cast("int"), 1) for i, p in enumerate(pivots()[band])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, rank: str | None = None) -> DataFrame:
    """(id, rank, fp): each row's fingerprint as a signed long; rank is another column of longs, or the id. Rows with a null id stay."""

    def make():
        def each(b: pa.RecordBatch) -> dict:
            return {id_col: b.column(0), "rank": b.column(1), "fp": pa.array([fingerprint(t, shingle) for t in utf8(b.column(2))], pa.uint64()).view(pa.int64())}

        return each

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(rank or id_col).cast("long").alias("rank"), F.col(text_col)), make, f"{id_col} long, rank long, fp long")


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within RADIUS bits; fps: distinct values of fp."""
    table = fps.select("fp", distances(F.col("fp")).alias("d"))
    for b in range(BANDS):
        table = table.withColumn(f"c{b}", F.xxhash64(F.lit(b), *coordinates("d", b)))
    keys = written(
        table.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), *(f"c{b}" for b in c)) for i, c in enumerate(combinations(range(BANDS), BANDS - RADIUS))))).alias("key"))
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = sizes.where(F.col("n") > heavy)
    small = keys.join(sizes.where(F.col("n") <= heavy).select("key"), "key")
    # The table is made again on either side instead of being shuffled: it is a function of fp.
    pair = small.toDF("key", "a").join(small.toDF("key", "b"), "key").where("a < b").select("a", "b").distinct()
    pair = pair.select("a", "b", distances(F.col("a")).alias("da"), distances(F.col("b")).alias("db"))
    near = pair.where(F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x - y))) <= RADIUS)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    dense = keys.join(crowded.select("key"), "key", "left_semi").select("fp").distinct()
    points = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))
    balls = dense.select("fp", F.explode(points).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("point", "b")
    met = balls.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.union(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, heavy: int = HEAVY) -> DataFrame:
    """One row per document: id, fp (signed long), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most RADIUS
    differing bits. Null, empty and wordless texts have fingerprint zero and
    link like any other; a null id has no component of its own but takes that
    of its fingerprint, if any. Repeated rows stay. Texts of any length are read
    whole. Other columns are not looked at, whatever their names. An empty table
    gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    of = _groups(prints, heavy)
    lowest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    member = of.join(lowest, "root").select("fp", "component_id")
    return prints.join(member, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _groups(prints: DataFrame, heavy: int) -> DataFrame:
    """(fp, root, first): the group of every fingerprint and its smallest rank."""
    first = written(prints.groupBy("fp").agg(F.min("rank").alias("first")))
    groups = connected(links(first.select("fp"), heavy)).withColumnsRenamed({"node": "fp", "component": "root"})
    return written(first.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def repeats(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, heavy: int = HEAVY) -> DataFrame:
    """key (a column of longs that tells rows apart) of every row but one of each group of near-duplicates, each once.

    The row with the smallest id stays, of several with it the one with the
    smallest key; null ids come last. A key that occurs more than once is one row.
    """
    prints = written(fingerprints(docs, key, text_col, shingle, id_col))
    member = prints.join(_groups(prints, heavy).select("fp", "root"), "fp").select("root", key, F.coalesce("rank", F.lit((1 << 63) - 1)).alias("rank"))
    stays = member.groupBy("root").agg(F.min(F.struct("rank", key)).alias("stays"))
    return member.join(stays, "root").where(F.col(key) != F.col(f"stays.{key}")).select(key).distinct()
