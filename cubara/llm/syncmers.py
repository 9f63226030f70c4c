"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is cut at white space into words; a word of more than LONG characters, as
where a script has no spaces, is cut into characters, as is a text of fewer than
FEW words. Of the runs of K such units, those are chosen whose smallest inner run
of S units (by hash) is the first or the last: closed syncmers. Whether a run is chosen depends on nothing outside it, so texts that
share a passage share its anchors, wherever it lies. A document's fingerprint is
the SIZE smallest 32-bit hashes of its syncmers, the likeness of two
fingerprints the share of the smallest of both together that are in both: an
estimate of the Jaccard similarity of the texts' syncmers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE, BLOCK_ROWS, LONG, FEW = 5, 2, 128, 500, 32, 10
#: Blocks at most: their ends are half a MB of the plan. 100 TB of text are 1.5 GB a block.
BLOCKS = 1 << 16
_STEP = 64
_SPACE = r"[\s\x85\p{Z}]+"


def bound(value: Column, body) -> Column:
    """body(value) with the value made once, as a lambda's variable, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _chosen(inner: Column, value) -> Column:
    """value(x, i) at every place of the run hashes where a closed syncmer begins, else null."""
    steps = K - S

    def at(x: Column, i: Column) -> Column:
        rest = [F.get(inner, i + j) for j in range(1, steps + 1)]
        low = F.least(x, *rest)
        return F.when((i < F.size(inner) - steps) & ((x == low) | (rest[-1] == low)), value(x, i, rest))

    return F.transform(inner, at)


def _units(text: Column) -> Column:
    letters = lambda w: F.array_remove(F.split(w, ""), "")
    cut = lambda words: F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG, letters(w)).otherwise(F.array(w))))
    few = lambda words: letters(F.array_join(words, " "))
    of = lambda words: F.when(F.size(words) < FEW, few(words)).when(F.exists(words, lambda w: F.char_length(w) > LONG), cut(words)).otherwise(words)
    return bound(F.array_remove(F.split(text, _SPACE), ""), of)


def _inner(text: Column, body) -> Column:
    """body(hashes of the runs of S = 2 words)."""
    words = F.transform(_units(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(h, lambda x, i: F.when(i < F.size(h) - 1, F.xxhash64(x, F.get(h, i + 1))))
    return bound(words, lambda h: bound(F.slice(runs(h), 1, F.greatest(F.size(h) - 1, F.lit(0))), body))


def _short(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 32)


def sketch(text: Column, size: int = SIZE) -> Column:
    """The fingerprint's hashes in order. A text without syncmers (fewer than K units, or by chance) has one hash of the whole; an empty or null one none."""
    # The second to the last of the inner runs cover all K = 5 words together with the first.
    every = _inner(text, lambda g: _chosen(g, lambda x, i, rest: _short(x, rest[1], rest[2])))
    low = F.slice(F.sort_array(F.array_distinct(F.filter(every, lambda y: y.isNotNull()))), 1, size)
    none = F.array().cast("array<bigint>")
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, none).otherwise(bound(low, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(_short(text)))))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of two sketches: 1 if equal (both empty, too), 0 if one is empty."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    joint = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(bound(joint, both))


def written_out(a: Column) -> Column:
    """A sketch as a string of 8 hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, anchor): every closed syncmer with the number of its first word, for positional matching. The number is that of its first unit. Null texts and texts of fewer than K units have none."""
    every = _inner(F.col(text_col), lambda g: _chosen(g, lambda x, i, rest: _short(x, rest[1], rest[2])))
    return docs.select(id_col, F.posexplode(every).alias("word", "anchor")).where("anchor is not null")


def in_blocks(docs: DataFrame, rows: int = BLOCK_ROWS, most: int = BLOCKS) -> DataFrame:
    """doc_id, text, block, extra: ranges of ids as blocks, each followed by what comes next in descending order.

    Blocks end at ids that are quantiles of all ids. The rows at a block's upper
    end stand in the block above it too, marked extra, and the rows of the
    largest id after those of the lowest block.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, top = thin.agg(F.count("doc_id"), F.max("doc_id")).first()
    blocks = min(most, max(1, -(-n // rows)))
    ends: list[int] = []
    if n and blocks > 1:
        ends = sorted(set(thin.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], min(20 * blocks, 1 << 18))).first()[0]) - {top})
    block = F.lit(0)
    at_end = F.lit(False)
    if ends:
        less = lambda a: F.size(F.filter(a, lambda e: e < F.col("doc_id")))
        longs = lambda v: F.lit(v).cast("array<bigint>") if v else F.array().cast("array<bigint>")
        levels = [longs(ends[n - 1 :: n]) for n in (_STEP * _STEP, _STEP, 1)]
        under = lambda a, c: c * _STEP + less(F.slice(a, c * _STEP + 1, F.lit(_STEP)))
        block = F.coalesce(bound(bound(less(levels[0]), lambda c: under(levels[1], c)), lambda c: under(levels[2], c)), F.lit(0))
        at_end = F.array_contains(F.slice(levels[2], F.col("block") + 1, F.lit(1)), F.col("doc_id"))
    place = lambda b, extra: F.struct(b.cast("int").alias("block"), F.lit(extra).alias("extra"))
    last = F.col("doc_id") == (F.lit(top) if top is not None else F.lit(None).cast("long"))
    places = F.array_compact(F.array(place(F.col("block"), False), F.when(at_end, place(F.col("block") + 1, True)), F.when(last, place(F.lit(0), True))))
    return thin.withColumn("block", block).select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.block", "p.extra")


def fingerprint_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n/2) characters replaced by the first as
    many (or all) of the next document in descending id order; after the last
    comes the first, so a lone document follows itself. Null texts are empty.
    Rows with one id follow each other in an order that their texts fix; null
    ids come after the smallest. Texts of any length are read whole. Other columns
    are not looked at, whatever their names. An empty table gives no rows.
    """
    order = Window.partitionBy("block").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = in_blocks(docs).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.select("doc_id", "text", "block", "extra", F.char_length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "block", "extra", "n_chars", F.col("text"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text"), size).alias("a"), sketch(F.col("edited"), size).alias("b"))
    rows = rows.withColumn("c", F.coalesce(F.lead("a").over(order), F.array().cast("array<bigint>"))).where("not extra")
    return rows.select("doc_id", "n_chars", "edited_sha256", written_out(F.col("a")).alias("fingerprint"), written_out(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b"), size).alias("near_edited"), likeness(F.col("a"), F.col("c"), size).alias("near_next"))
