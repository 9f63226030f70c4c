"""Shared places, Arrow batches and linked groups: what several operators here use."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder of spark.checkpoint.dir. Where that is unset, local
    sessions use a temporary folder of this machine and others the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="cubara-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cubara"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/cubara-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir gave, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended before
            if path.startswith("file:///") and os.path.isdir(path[7:]):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that written() gave, once what was made of them is written itself."""
    for t in tables:
        remove(t.sparkSession, _paths.pop(t))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow where make() runs once a task and its result turns slices of at most `rows` rows into columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, each = to_arrow_schema(fields), make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = each(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # a worker idles between tasks with what it holds

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in ascending id order over the partitions and in them, null ids first; rows of one id in the order of a hash of their texts, so that many of them don't meet in one task."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return thin.repartitionByRange(*order).sortWithinPartitions(*order)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges(a, b), by alternating large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm
    of the longest path. Nulls are no nodes; loops and repeated links are
    allowed; an empty table gives an empty one. Nothing is gathered by node:
    only minima are, which combine before the shuffle.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null").distinct()
    )
    before = None
    while True:
        # large star: every larger neighbour moves to the smallest neighbour
        both = links.union(links.select("v", "u").toDF("u", "v")).where("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = links.where("u = v")
        large = large.union(loops.select("u", "v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        small = written(small)
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(links)
        links = small
        if state == before:
            break
        before = state
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


#: Bits of a sieve. It is at most 2^20 rows of two numbers, whatever the input: some 16 MB.
SIEVE = 26


def sieved(table: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """table with a column `maybe`: true for rows that have an equal in wanted on these columns and, by chance, for others.

    A bitmap of the hashes in wanted is broadcast; its size has a bound, so one
    plan serves all sizes. The fuller it is, the more other rows are true, so an
    exact join must follow. Nulls are hashed like other values.
    """
    place = F.xxhash64(*on).bitwiseAND(F.lit((1 << SIEVE) - 1))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sieve = wanted.select(word.alias("sieve_word"), one.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    rows = table.withColumn("sieve_place", place).withColumn("sieve_word", F.shiftright("sieve_place", 6))
    maybe = F.coalesce(F.getbit("sieve_bits", F.col("sieve_place").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(sieve), "sieve_word", "left").select(*table.columns, maybe.alias("maybe"))


def joined(table: DataFrame, wanted: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An inner, left, left_semi or left_anti join of a large table with a written one; the large one's rows without an equal aren't shuffled."""
    rows = sieved(table, wanted, *on)
    out = rows.where("maybe").drop("maybe").join(wanted, on, how)
    return out.unionByName(rows.where("not maybe").drop("maybe"), allowMissingColumns=True) if how in ("left", "left_anti") else out
