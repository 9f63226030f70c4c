"""A corpus from raw documents to packed sequences: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubara.llm import decontaminate, langid, lines, packing, simhash
from cubara.llm.shared import joined, sieved, written

#: A document whose largest language has less than this share is taken for no text of any language.
LEAST_SHARE = 0.4


def _only(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of all that a row holds, which carries decisions about it: neither a null nor a repeated id matters."""
    docs = _only(docs)
    return docs.withColumn("key", F.xxhash64(*docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the labels teach, go.

    So do null and empty texts. Null and repeated ids and repeated rows are judged
    each by its text; an empty table gives no rows.
    """
    docs = _keyed(docs)
    found = langid.predict(docs.select(F.col("key").alias("doc_id"), "text"), langid.learnt(docs))
    gone = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)).select(F.col("doc_id").alias("key")).distinct()
    return _only(joined(docs, written(gone), ["key"], "left_anti"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents stay, with their new length.

    A null text stays null, with a null length. Rows with equal id and text have
    one result; lines of null ids come last; an empty table gives no rows.
    """
    done = lines.dedup_lines(_only(docs), keep=("lang", "source"))
    return _only(done.withColumn("n_chars", F.char_length("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id.

    Of rows with that id one stays, and of rows that are equal throughout; null
    ids come last. Null, empty and wordless texts are one group. An empty table
    gives no rows.
    """
    docs = _keyed(docs)
    gone = written(simhash.repeats(docs, "key"))
    twice = written(docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = sieved(docs, gone.union(twice), "key")
    maybe = rows.where("maybe").join(gone, "key", "left_anti").dropDuplicates(["key"])
    return _only(rows.where("not maybe")).union(_only(maybe))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in at least one of twenty words go.

    Null and empty texts stay, as do rows with null or repeated ids: each is
    judged by its text. An empty benchmark or table takes nothing away.
    """
    docs = _keyed(docs)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    gone = found.where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return _only(joined(docs, written(gone), ["key"], "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, in document order: see packing.pack for nulls, ties, repeated rows and empty tables."""
    return packing.pack(_only(docs), public_tokenizers.path("byte_bpe_50k.json"), 1, remember=False)  # the workers serve other stages, too


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", pack)]

#: Tokens, mixtures and components are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
