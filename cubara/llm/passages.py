"""Repeated passages by paragraph MinHash banding.

A paragraph is a line. Its set of five-word shingles (ASCII-lower-cased words;
fewer words make one shingle) has BANDS keys of ROWS minima each, so that two
paragraphs of Jaccard similarity 0.8 share a key with probability 0.9992
(1 - (1 - 0.8^3)^10). Paragraphs with a common key are paired, the exact
similarity of their sets is verified, and linked paragraphs are one class by
components. Equal paragraphs are one from the start, and so are equal texts: the
one with the smallest id stands for all.

A passage that was put into a paragraph leaves that paragraph's set unlike any
other, so texts are banded by single minima, too: every min_words consecutive
words, line ends or not, are a window, and its key, the anchor, is the least hash
of the runs of half as many words in it. Equal windows have equal anchors, and
neighbouring windows mostly one anchor in one place together, a stretch. Only stretches whose
anchor stands in several places are compared: first as a whole, by a hash of all
their words; then, but for those that stand earlier as a whole, window by window.

A passage is a run of neighbouring words that are repeated by their paragraph or
window, and is reported from min_words words on. Where that many words in a row
occur earlier they are a passage to remove by themselves; what is left of the run
before and after stays.

A key of more than HEAVY different paragraphs isn't paired in full: its members
are first paired with LEADERS of them, other ones for every key. Where that
leaves a key's members in more than one component, an exact prefix-filtered
join over their sets finds every link between components. So only links inside
a component are left out, which change no class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import connected, forget, joined, map_batches, sieved, utf8, written

SHINGLE, BANDS, ROWS, SIMILARITY, HEAVY, LEADERS = 5, 10, 3, 0.8, 24, 4
#: Passages of over 50 words.
MIN_WORDS = 51
#: Stands for a null id, so that it comes last.
LAST = (1 << 63) - 1
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_rng = np.random.default_rng(20)
_TIMES = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _hashed(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _of_ranges(hashed: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the words [lo, hi) of each range, wherever it lies: a polynomial, from its sums up to either end."""
    base = int(_TIMES[which])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * _powers(base, len(hashed))[:-1])))
    moved = (sums[hi] - sums[lo]) * _powers(pow(base, -1, 1 << 64), len(hashed))[lo]
    return _mixed(moved ^ ((hi - lo).astype(np.uint64) * _PLACES[3]))


def _shingled(hashed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all the ranges in a row, repeats included, and where each range's begin.

    A shingle is the sum of its words' hashes, each times a fixed odd number of
    its place; missing words of short ranges add nothing.
    """
    n = hi - lo
    places = np.maximum(n, SHINGLE)
    begin, counts = np.cumsum(places) - places, places - SHINGLE + 1
    flat = np.zeros(places.sum(), np.uint64)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    flat[np.repeat(begin, n) + within] = hashed[np.repeat(lo, n) + within]
    size = len(flat) - SHINGLE + 1
    total = flat[:size] * _PLACES[0]
    for j in range(1, SHINGLE):
        total += flat[j : j + size] * _PLACES[j]
    starts = np.cumsum(counts) - counts
    return total[np.repeat(begin - starts, counts) + np.arange(counts.sum())], starts


def _few(total: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each paragraph, whether it has fewer than four different shingles."""
    ends = np.append(starts[1:], len(total))
    few = ends - starts < 4
    at = starts[~few]
    first = [total[at + k] for k in range(4)]
    same = np.zeros(len(at), bool)
    for i in range(4):
        for j in range(i):
            same |= first[i] == first[j]
    for k in np.flatnonzero(~few)[same]:  # its first four aren't all different: look at all
        few[k] = len(np.unique(total[starts[k] : ends[k]])) < 4
    return few


def bands(hashed: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys one after another as signed longs, number of keys) of the ranges of words. Sets of fewer than four shingles are alike only if equal: one key."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, starts = _shingled(hashed, lo, hi)
    least = [np.minimum.reduceat(total * t + p, starts) for t, p in zip(_TIMES, _PLUS)]
    keys = np.empty((len(lo), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lo), b, np.uint64)
        for m in least[b * ROWS : (b + 1) * ROWS]:
            key = _mixed(key ^ m)
        keys[:, b] = key
    one = keys[:, 0].copy()
    for b in range(1, BANDS):
        one = _mixed(one ^ keys[:, b])
    few = _few(total, starts)
    keys[few, 0] = one[few]
    wanted = np.ones(keys.shape, bool)
    wanted[few, 1:] = False
    return keys[wanted].view(np.int64), wanted.sum(axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers: odd products and shifts."""
    x = (x ^ (x >> np.uint64(32))) * _PLACES[0]
    x = (x ^ (x >> np.uint64(29))) * _PLACES[1]
    return x ^ (x >> np.uint64(32))


def _halves(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words."""
    n = len(hashed) - size + 1
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total ^ hashed[j : j + n]) * _PLACES[0]
        total ^= total >> np.uint64(31)
    return _mixed(total)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values."""
    n, done = len(values) - size + 1, 1
    while done < size:
        step = min(done, size - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values[:n]


def _anchors(hashed: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each min_words consecutive words the run of half as many that has the least hash, by its upper 32 bits, the first of equal ones: its place, and the hash of each place."""
    half = (min_words + 1) // 2
    parts = _halves(hashed, half)
    ordered = (parts >> np.uint64(32) << np.uint64(32)) | np.arange(len(parts), dtype=np.uint64)
    return (_least(ordered, min_words - half + 1) & np.uint64((1 << 32) - 1)).astype(np.int64), parts


def _folded(text: bytes | None) -> list[list[bytes]]:
    """The words of each line that has some."""
    return [w for line in (text or b"").translate(_FOLD).split(b"\n") if (w := line.split())]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, second, text): null ids are LAST, row and second are two hashes of the text; null and empty texts go."""
    text = F.col(text_col)
    return docs.where(F.octet_length(text) > 0).select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.hash(text).alias("second"), text.alias("text"))


def _different(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, row, text, copied): every different text once, in its smallest doc; and (row, second, doc, first) of the other docs with it. Only texts of copies are shuffled."""
    groups = texts.select("row", "second", "doc").groupBy("row", "second").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    twice = written(groups.where("n > 1").select("row", "second", "first", (F.col("first") < F.col("last")).alias("spread")))
    rows = sieved(texts, twice, "row", "second")
    maybe = rows.where("maybe").join(twice, ["row", "second"], "left")
    once = maybe.where("first is null").union(maybe.where("first = doc").dropDuplicates(["row"]))
    names = ["doc", "row", "text"]
    reps = rows.where("not maybe").select(*names, F.lit(False).alias("copied")).union(once.select(*names, F.coalesce("spread", F.lit(False))))
    copies = joined(texts.select("row", "second", "doc"), twice, ["row", "second"]).where("doc <> first").distinct()
    return reps, copies


#: Kinds of rows of _units.
PARAGRAPH, STRETCH, WHOLE = 0, 1, 2


def _units(reps: DataFrame, min_words: int) -> DataFrame:
    """(kind, doc, row, lo, hi, h, second, keys), from one reading of the texts; lo and hi count words.

    A PARAGRAPH is its words, two hashes of them and its keys. A STRETCH is the
    words of neighbouring windows with one anchor, which is h; second is a hash
    of them all. WHOLE is a text that has copies.
    """
    schema = "kind int, doc long, row long, lo int, hi int, h long, second long, keys array<long>"

    def make():
        def each(b: pa.RecordBatch) -> dict:
            words: list[bytes] = []
            para, ends = [0], [0]  # where paragraphs and texts end
            count = []
            for text in utf8(b.column(2)):
                lines = _folded(text)
                for w in lines:
                    words += w
                    para.append(len(words))
                count.append(len(lines))
                ends.append(len(words))
            hashed, para, ends = _hashed(words), np.array(para), np.array(ends)
            doc, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            of = np.repeat(np.arange(len(doc)), count)
            lo, hi = para[:-1], para[1:]
            h = _of_ranges(hashed, lo, hi)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            keys, n = bands(hashed, lo[first], hi[first])
            own = np.cumsum(n) - n
            size = n[back]
            keys = keys[np.repeat(own[back] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            parts = [(PARAGRAPH, of, lo, hi, h, _of_ranges(hashed, lo, hi, 1))]
            if len(words) >= min_words:
                at, parts_of = _anchors(hashed, min_words)
                text_of = np.repeat(np.arange(len(doc)), np.diff(ends))
                inside = text_of[: len(at)] == text_of[min_words - 1 :]
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (text_of[1 : len(at)] != text_of[: len(at) - 1])))
                edge = np.flatnonzero(new | ~inside)
                stop = np.append(edge[1:], len(at))[inside[edge]] + min_words - 1
                edge = edge[inside[edge]]
                parts.append((STRETCH, text_of[edge], edge, stop, parts_of[at[edge]], _of_ranges(hashed, edge, stop, 1)))
            whole = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False) & (np.diff(ends) > 0))
            parts.append((WHOLE, whole, ends[whole], ends[whole + 1], np.zeros(len(whole), np.uint64), np.zeros(len(whole), np.uint64)))
            of = np.concatenate([p[1] for p in parts])
            offsets = np.concatenate(([0], np.cumsum(size)))
            none = np.full(sum(len(p[1]) for p in parts[1:]), offsets[-1])
            return {
                "kind": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]),
                "doc": doc[of],
                "row": row[of],
                "lo": np.concatenate([p[2] for p in parts]) - ends[of],
                "hi": np.concatenate([p[3] for p in parts]) - ends[of],
                "h": np.concatenate([p[4] for p in parts]).view(np.int64),
                "second": np.concatenate([p[5] for p in parts]).view(np.int64),
                "keys": pa.ListArray.from_arrays(pa.array(np.concatenate((offsets, none)), pa.int32()), pa.array(keys, pa.int64())),
            }

        return each

    return written(map_batches(reps.select("doc", "row", "text", "copied"), make, schema, rows=256))


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ph, shingles) of the wanted paragraphs (doc, row, lo, hi), read from the texts that hold them."""
    by_text = written(wanted.groupBy("doc", "row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")))

    def make():
        def each(b: pa.RecordBatch) -> dict:
            out: dict = {"ph": [], "shingles": []}
            for text, los, his in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                hashed = _hashed([w for line in _folded(text) for w in line])
                lo, hi = np.array(los), np.array(his)
                out["ph"] += _of_ranges(hashed, lo, hi).view(np.int64).tolist()
                total, starts = _shingled(hashed, lo, hi)
                out["shingles"] += [np.unique(x).view(np.int64) for x in np.split(total, starts[1:])]
            return out

        return each

    return map_batches(joined(texts, by_text, ["doc", "row"]).select("text", "los", "his"), make, "ph long, shingles array<long>", rows=128).dropDuplicates(["ph"])


def paragraph_links(units: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): different paragraphs (by their hash) whose sets are at least as similar, verified exactly."""
    paras = units.where(F.col("kind") == PARAGRAPH)
    every = paras.select(F.col("h").alias("ph"), F.explode("keys").alias("key"))
    # Most keys have one paragraph or copies of it: only keys of two different ones go on.
    shared = written(every.groupBy("key").agg(F.min("ph").alias("lo"), F.max("ph").alias("hi")).where("lo < hi").select("key"))
    keyed = written(joined(every, shared, ["key"], "left_semi").distinct())
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")))
    light = keyed.join(sizes.where(F.col("n") <= HEAVY).select("key"), "key").select("key", "ph")
    pairs = light.toDF("key", "a").join(light.toDF("key", "b"), "key").where("a < b").select("a", "b")
    crowd = written(keyed.join(sizes.where(F.col("n") > HEAVY).select("key"), "key").select("key", "ph"))
    low = [F.min_by("ph", F.xxhash64("ph", "key", F.lit(k))) for k in range(LEADERS)]
    heavy = crowd.groupBy("key").agg(F.array(*low).alias("leaders"))
    led = crowd.join(heavy, "key").select("ph", F.explode("leaders").alias("l")).where("ph <> l")
    pairs = written(pairs.union(led.select(F.least("ph", "l"), F.greatest("ph", "l"))).distinct())
    forget(shared, keyed, sizes)
    used = written(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    wanted = joined(paras.select("doc", "row", "lo", "hi", "h"), used, ["h"]).groupBy("h").agg(F.min(F.struct("doc", "row", "lo", "hi")).alias("p")).select("p.*")
    sets = written(_sets(texts, wanted))
    links = written(_alike(pairs, sets, similarity))
    return links if crowd.isEmpty() else links.union(_across(crowd, links, sets, similarity))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least this Jaccard similarity."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


#: Buckets of shingles that are counted for their order.
COUNTED = 1 << 16


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (shingles) fall into each of COUNTED buckets: a table of fixed size."""

    def count(batches):
        total = np.zeros(COUNTED, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy().view(np.uint64) % COUNTED, minlength=COUNTED)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(COUNTED, np.int64)
    for r in sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(t, ph, c, n, i, p) for each shingle t of the prefix p of the set of ph, its place i in it from 1 and the set's size n. All sets have one order of shingles, rare buckets first."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def make():
        def each(b: pa.RecordBatch) -> dict:
            out: dict = {"t": [], "ph": [], "c": [], "n": [], "i": [], "p": []}
            for ph, c, shingles_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = shingles_.values.to_numpy()
                first = t[np.lexsort((t, rarity.value[t.view(np.uint64) % COUNTED]))][: len(t) - int(np.ceil(similarity * len(t) - 1e-9)) + 1]
                k = len(first)
                for name, v in zip(out, (first, np.full(k, ph), np.full(k, c), np.full(k, len(t)), np.arange(1, k + 1))):
                    out[name].append(v)
                out["p"] += [first] * k
            return {k: v if k == "p" else np.concatenate(v) if v else [] for k, v in out.items()}

        return each

    return map_batches(sets.select("ph", "c", "shingles"), make, "t long, ph long, c long, n int, i int, p array<long>")


def _across(crowd: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every link between members of crowded keys (key, ph) that the links so far leave in different components.

    Two sets that are alike share a shingle of both prefixes; at the first shared
    one, what follows in the shorter rest bounds the number in common. A pair
    comes up once, at that shingle.
    """
    parts = connected(links).select(F.col("node").alias("ph"), "component")
    crowd = crowd.join(parts, "ph", "left").select("key", "ph", F.coalesce("component", "ph").alias("c"))
    split = crowd.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rest = written(crowd.join(split, "key").select("ph", "c").distinct())
    prefix = written(_prefixes(written(joined(sets, rest, ["ph"])), similarity))
    x, y = prefix.toDF("t", "a", "ca", "na", "ia", "pa"), prefix.toDF("t", "b", "cb", "nb", "ib", "pb")
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    near = x.join(y, "t").where((F.col("ca") < F.col("cb")) & (most * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-9) & (F.array_intersect("pa", "pb")[0] == F.col("t")))
    return _alike(written(near.select("a", "b")), sets, similarity)


def repeated_windows(units: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """(doc, row, lo, hi, least, later): words [lo, hi) all of whose min_words consecutive ones stand elsewhere, too, one of them in the document least, and whether that is an earlier place."""
    every = units.where(F.col("kind") == STRETCH).select("doc", "row", "lo", "hi", F.col("h").alias("anchor"), "second")
    shared = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    stretches = written(joined(every, shared, ["anchor"], "left_semi"))
    forget(shared)
    place = F.struct("doc", "row", "lo")
    first = stretches.groupBy("second").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("second", "first")
    first = written(first)
    # As a whole in an earlier place: done. The first of equal ones stands for them among the others.
    placed = stretches.join(first, "second", "left").withColumn("later", F.coalesce(F.col("first") != place, F.lit(False)))
    wholes = written(placed.where("later").select("doc", "row", "lo", "hi", F.col("first.doc").alias("least"), "later"))
    rest = placed.where("not later").withColumn("several", F.col("first").isNotNull())
    rest = written(rest.groupBy("doc", "row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"), F.collect_list("several").alias("several")))
    forget(stretches, first)

    def compared():
        def each(b: pa.RecordBatch) -> dict:
            out: dict = {"doc": [], "row": [], "at": [], "w": [], "several": []}
            for text, doc, row, los, his, several in zip(utf8(b.column(0)), *(b.column(k).to_pylist() for k in range(1, 6))):
                hashed = _hashed([w for line in _folded(text) for w in line])
                n = np.array(his) - np.array(los) - min_words + 1
                at = np.repeat(np.array(los) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out["doc"].append(np.full(len(at), doc))
                out["row"].append(np.full(len(at), row))
                out["at"].append(at)
                out["w"].append(_of_ranges(hashed, at, at + min_words, 2).view(np.int64))
                out["several"].append(np.repeat(several, n))
            return {k: np.concatenate(v) if v else [] for k, v in out.items()}

        return each

    found = joined(texts.select("doc", "row", "text"), rest, ["doc", "row"]).select("text", "doc", "row", "los", "his", "several")
    windows = written(map_batches(found, compared, "doc long, row long, at int, w long, several boolean", rows=128))
    place = F.struct("doc", "row", "at")
    first = windows.groupBy("w").agg(F.max("several").alias("several"), F.min(place).alias("first"), F.max(place).alias("last")).where("several or first <> last").select("w", "first")
    again = joined(windows.select("doc", "row", "at", "w"), written(first), ["w"])
    again = again.select("doc", "row", F.col("at").alias("lo"), (F.col("at") + min_words).alias("hi"), F.col("first.doc").alias("least"), (F.col("first") != place).alias("later"))
    return wholes.union(again)


def _merged(lo: np.ndarray, hi: np.ndarray, least: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of one least and later that touch, as one."""
    o = np.lexsort((lo, later, least))
    lo, hi, least, later = lo[o], hi[o], least[o], later[o]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (later[1:] != later[:-1]) | (lo[1:] > hi[:-1])))
    at = np.flatnonzero(new)
    return lo[at], np.maximum.reduceat(hi, at), least[at], later[at]


def _passages(marks: DataFrame, min_words: int) -> DataFrame:
    """Passages from repeated ranges (doc, row, lo, hi, least, later) of words."""
    spans = marks.groupBy("doc", "row").agg(*(F.collect_list(c).alias(c) for c in ("lo", "hi", "least", "later")))
    schema = "doc long, first_word long, n_words long, least long, removed boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        def each(b: pa.RecordBatch) -> dict:
            out: dict = {n: [] for n in names}
            for doc, *ranges in zip(b.column(0).to_pylist(), *(b.column(k) for k in range(1, 5))):
                los, his, leasts, laters = _merged(*(np.array(x.values) for x in ranges))
                # 0 not repeated, 1 repeated, 2 with an earlier place; one more word ends the last stretch.
                kind, least = np.zeros(his.max() + 1, np.int8), np.full(his.max() + 1, LAST)
                for lo, hi, x, later in zip(los.tolist(), his.tolist(), leasts.tolist(), laters.tolist()):
                    np.maximum(kind[lo:hi], 2 if later else 1, out=kind[lo:hi])
                    np.minimum(least[lo:hi], x, out=least[lo:hi])
                for lo, hi in _stretches(kind == 2):  # fewer words than a passage has go with what is around them
                    if hi - lo < min_words:
                        kind[lo:hi] = 1
                for k in (1, 2):
                    for lo, hi in _stretches(kind == k):
                        if hi - lo >= min_words:
                            for n, v in zip(names, (doc, lo, hi - lo, int(least[lo:hi].min()), k == 2)):
                                out[n].append(v)
            return out

        return each

    return map_batches(spans.select("doc", "lo", "hi", "least", "later"), make, schema, rows=128)


def _stretches(on: np.ndarray) -> list[tuple[int, int]]:
    """[lo, hi) of each run of true values; the last value is false."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], on)).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_word, n_words, first_doc, removed: every passage of at least min_words that occurs elsewhere, too.

    Words are numbered from 0 over the whole text; a passage is its n_words words
    from first_word on. first_doc is a document that holds a part of the passage
    or its near-duplicate, the smallest but where copies of stretches stand for
    each other; removed says that all of it occurs earlier (in a smaller doc_id,
    or before in the same text). A text that a smaller doc_id holds, too, is one
    passage from its first word to its last. Null and empty texts have no
    passages, rows with equal id and text are one document, null ids come last.
    Texts are read whole; one task holds one at a time. Other columns are not
    looked at, whatever their names. An empty table gives no rows.
    """
    texts = _texts(docs, id_col, text_col)
    reps, copies = _different(texts)
    units = _units(reps, min_words)
    classes = connected(paragraph_links(units, texts)).select(F.col("node").alias("h"), F.col("component").alias("class"))
    names = ["doc", "row", "lo", "hi", "least", "later"]
    # Classes of paragraphs with more than one place, and the earliest of them.
    paras = units.where(F.col("kind") == PARAGRAPH).select("doc", "row", "lo", "hi", "h", "second")
    several = paras.groupBy("h", "second").agg(F.count("*").alias("n")).join(classes, "h", "left").where("n > 1 or class is not null")
    several = written(several.select("h", "second", F.coalesce("class", "h").alias("class"), F.coalesce(F.col("class") * 0, F.col("second")).alias("of")))
    heads = written(joined(paras, several, ["h", "second"]).drop("h", "second"))
    place = F.struct("doc", "row", "lo")
    first = heads.groupBy("class", "of").agg(F.min(place).alias("first"))
    by_paragraph = heads.join(first, ["class", "of"]).select("doc", "row", "lo", "hi", F.col("first.doc").alias("least"), (F.col("first") != place).alias("later"))
    whole = units.where(F.col("kind") == WHOLE).select("doc", "row", "lo", "hi")
    marks = by_paragraph.union(repeated_windows(units, texts, min_words).select(names)).union(whole.select(*names[:4], F.col("doc").alias("least"), F.lit(False)))
    real = lambda c: F.nullif(F.col(c), F.lit(LAST))
    found = _passages(marks, min_words).select(real("doc").alias("doc_id"), "first_word", "n_words", real("least").alias("first_doc"), "removed")
    sizes = whole.where(F.col("hi") >= min_words).select("row", F.col("doc").alias("first"), F.col("hi").alias("n_words"))
    copied = copies.join(sizes, ["row", "first"]).select(real("doc").alias("doc_id"), F.lit(0).cast("long"), F.col("n_words").cast("long"), real("first").alias("first_doc"), F.lit(True))
    return found.union(copied)
