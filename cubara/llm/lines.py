"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Of equal lines the earliest (by doc_id, then line number) stays; short lines of white
space alone aren't compared. A line also goes if an earlier one lies within one
edit (a character inserted, deleted or replaced), where both have at least LEAST
characters; both are full texts, not normalised. Which lines are within one edit follows from deletion variants:

- two lines of length m differ by a replacement at i if and only if they are
  equal without their i-th character: keys (m, i, hash of the rest);
- a line of length m + 1 loses a character to become one of length m: keys
  (m, hash of the rest) and (m, hash of the whole).

In a group of one such key all members are within one edit of each other (or of
the members on the other side), so the earliest of the group settles all of it
and no pairs are made. Before variants are emitted, two rounds of cheaper keys
show where an edit can be at all: within one edit, either the first half or the
rest of the shorter length is equal; then, for lines that share a half, all
around a stretch of SEGMENT characters. Only the characters of such stretches
are deleted, so the variants of a long line stay few, and the result is that of
the full neighbourhood. What the keys find is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import forget, joined, written
from cubara.llm.syncmers import bound

LEAST, SEGMENT = 16, 64
_LAST = (1 << 63) - 1
_ID = ["h1", "h2"]


def _rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, row (and what to keep): rows with equal id and text are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"kept_{c}") for c in keep), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))


def _tail(line: Column, n: Column) -> Column:
    """The last n characters."""
    return F.substring(line, F.char_length(line) - n + 1, F.greatest(n, F.lit(0)))


def _halves(line: Column) -> Column:
    """Keys of the two halves, for either length m that the shorter line of a pair can have."""
    n = F.char_length(line)
    keys = []
    for less in (0, 1):
        m = n - less
        h = F.shiftright(m, 1)
        keys += [F.xxhash64(m, F.lit(0), F.substring(line, F.lit(1), h)), F.xxhash64(m, F.lit(1), _tail(line, m - h))]
    return F.array(*keys)


def removed_lines(docs: DataFrame, least: int = LEAST, equal: int = 1) -> DataFrame:
    """(row, gone), written: for each document with lines to remove, their numbers from 0 in order. See dedup_lines for the two lengths."""
    rows = _rows(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row", "line_no")
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where((F.char_length("line") >= min(least, equal)) & F.when(F.char_length("line") < least, F.col("line").rlike(r"\S")).otherwise(True))
    lines = written(lines.select(place.alias("at"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.char_length("line").alias("n"), F.when(F.char_length("line") >= least, _halves(F.col("line"))).alias("keys")))

    # Where halves of different lines are equal.
    keyed = lines.select(*_ID, "n", F.posexplode("keys").alias("which", "key"))
    shared_keys = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    shared_keys = written(shared_keys)
    halves = joined(keyed, shared_keys, ["key"], "left_semi").select(*_ID, "n", (F.col("n") - F.shiftright("which", 1)).alias("m"), F.col("which").bitwiseAND(F.lit(1)).alias("half")).distinct()
    halves = written(halves)
    forget(shared_keys)
    candidates = written(halves.select(*_ID).distinct())
    firsts = written(joined(lines, candidates, _ID, "left_semi").groupBy(*_ID).agg(F.min("at").alias("at")))
    forget(candidates)

    # The texts of these lines, from the documents that hold them first.
    wanted = firsts.select("at.row", F.struct("at.line_no", *_ID, "at").alias("c")).groupBy("row").agg(F.collect_list("c").alias("cs"))
    wanted = written(wanted)
    found = joined(rows, wanted, ["row"]).select(
        F.explode(bound(F.split("text", "\n"), lambda parts: F.transform("cs", lambda c: F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), c["at"].alias("at"), F.get(parts, c["line_no"]).alias("line"))))).alias("x")
    )
    texts = written(found.select("x.*").dropDuplicates(_ID))
    forget(firsts, wanted)

    # Where all around a stretch of a few characters is equal: [lo, hi) holds the edit.
    near = halves.join(texts, _ID)
    h = F.shiftright("m", 1)
    begin, end = F.when(F.col("half") == 0, h).otherwise(0), F.when(F.col("half") == 0, F.col("m")).otherwise(h)
    cuts = F.when(end > begin, F.sequence(begin, end - 1, F.lit(SEGMENT))).otherwise(F.array(begin))
    near = near.select(*_ID, "n", "m", "line", F.explode(cuts).alias("lo"), end.alias("end")).withColumn("hi", F.least(F.col("lo") + SEGMENT, "end"))
    near = near.withColumn("key", F.xxhash64("m", "lo", F.substring("line", F.lit(1), F.col("lo")), F.lit("|"), _tail(F.col("line"), F.col("m") - F.col("hi")))).select(*_ID, "n", "m", "lo", "hi", "key").distinct()
    near = all_near = written(near)
    shared_keys = near.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")
    shared_keys = written(shared_keys)
    near = joined(near, shared_keys, ["key"], "left_semi")

    # Deletion variants within these stretches. side: 0 replacements, 1 the whole shorter line, 2 the longer line without a character.
    line, i = F.col("line"), F.col("i")
    rest = F.xxhash64(F.substring(line, F.lit(1), i), F.substring(line, i + 2, F.char_length(line)))
    shorter = F.xxhash64(F.concat(F.substring(line, F.lit(1), i), F.substring(line, i + 2, F.char_length(line))))
    stretch = near.join(texts, _ID)
    spots = stretch.withColumn("i", F.explode(F.sequence(F.col("lo"), F.when(F.col("n") == F.col("m"), F.greatest(F.col("lo"), F.col("hi") - 1)).otherwise(F.col("hi")))))
    variants = spots.where("n = m").select(*_ID, "at", F.lit(0).alias("side"), F.xxhash64(F.lit(0), "m", "i", rest).alias("key"))
    variants = variants.union(stretch.where("n = m").select(*_ID, "at", F.lit(1), F.xxhash64(F.lit(1), "m", F.xxhash64("line"))))
    variants = variants.union(spots.where("n = m + 1").select(*_ID, "at", F.lit(2), F.xxhash64(F.lit(1), "m", shorter)))
    variants = written(variants.distinct())
    own = F.struct("at", *_ID)
    first = lambda side: F.min(F.when(F.col("side") == side, own))
    lowest = variants.groupBy("key").agg(first(0).alias("w0"), first(1).alias("w1"), first(2).alias("w2"))
    beaten = variants.join(lowest, "key").withColumn("w", F.when(F.col("side") == 0, F.col("w0")).when(F.col("side") == 1, F.col("w2")).otherwise(F.col("w1")))
    beaten = beaten.where(F.col("w.at") < F.col("at")).select(*_ID, F.col("w.h1").alias("g1"), F.col("w.h2").alias("g2")).distinct()
    winner = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("kept"))
    beaten = beaten.join(winner, ["g1", "g2"]).join(texts.select(*_ID, "line"), _ID).where(F.levenshtein("line", "kept", 1) == 1).select(*_ID).distinct()

    # All places of lines that go, and all but the first of lines that occur more than once.
    again = lines.groupBy(*_ID).agg(F.count("*").alias("times"), F.min("at").alias("first")).where("times > 1").select(*_ID, "first")
    gone = again.join(beaten.withColumn("near", F.lit(True)), _ID, "full").select(*_ID, "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = written(gone)
    places = joined(lines, gone, _ID).where("near or at != first")
    done = written(places.select("at.row", "at.line_no").distinct().groupBy("row").agg(F.sort_array(F.collect_list("line_no")).alias("gone")))
    forget(lines, halves, texts, all_near, shared_keys, variants, gone)
    return done


def dedup_lines(docs: DataFrame, least: int = LEAST, keep: tuple[str, ...] = (), equal: int = 1) -> DataFrame:
    """doc_id, text, n_lines, n_removed and the columns `keep` of every document; text without the removed lines, the others as they were.

    A null text has no lines and stays null; an empty text is one empty line.
    Lines of at least `equal` characters that aren't short white space are
    compared for equality, lines of at least `least` for equality and one edit;
    others stay. Rows with equal id and text count as one
    document: all get the same text. Lines of a null id come last. An empty
    table gives no rows.
    """
    gone = removed_lines(docs, least, equal)
    rows = joined(_rows(docs, keep), gone, ["row"], "left")
    parts = F.split("text", "\n")
    # What stays is told by place, with the removed numbers as an array of a document's own size.
    stay = lambda p: F.filter(p, lambda line, i: (F.char_length(line) < min(least, equal)) | ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(bound(parts, stay), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return rows.select("doc_id", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), *(F.col(f"kept_{c}").alias(c) for c in keep))
