"""Streams of steps: incremental aggregates, windows with a watermark, and the watcher of changed products."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Aggregates that update as steps come; a median would need all values.
INCREMENTAL = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "count": F.count}


def step_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet steps of a folder in order of arrival, a batch at a time: a step that isn't there yet is waited for, none is skipped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running(stream: DataFrame, how: str, by: tuple[str, ...] = ("y", "x"), v: str = "v") -> DataFrame:
    """An aggregate of each pixel over all steps so far, for output mode update (progressive) or complete. State is one row a pixel."""
    if how not in INCREMENTAL:
        raise ValueError(f"{how!r} isn't incremental: {', '.join(INCREMENTAL)}")
    return stream.groupBy(*by).agg(INCREMENTAL[how](F.col(v)).alias(v))


def windowed(stream: DataFrame, time: str, width: str, late: str, by: tuple[str, ...] = (), v: str = "v") -> DataFrame:
    """n, mean, min, max of tumbling windows; rows later than the watermark are dropped, and its windows end."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")).select(F.col("window.start").alias("start"), *by, "n", "mean", "min", "max")


_CHANGES = "path string, stamp string"
_STATE = "shown string, pending string"


def _settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    shown, pending = state.get if state.exists else (None, None)
    out = []
    stamps = pd.concat(list(batches)).sort_values("poll")["stamp"]
    for stamp in stamps:
        if shown is None:
            shown = stamp  # the first sight is what is open already
        elif stamp == shown:
            pending = None
        elif stamp == pending:
            out.append(stamp)
            shown, pending = stamp, None
        else:
            pending = stamp
    state.update((shown, pending))
    if out:
        yield pd.DataFrame({"path": [key[0]] * len(out), "stamp": out})


def changed_products(polls: DataFrame) -> DataFrame:
    """(path, stamp) of products that changed, from polls(path, stamp, poll number): a new stamp counts once it is the same for a further poll."""
    return polls.groupBy("path").applyInPandasWithState(_settle, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def changed_batch(polls: DataFrame) -> DataFrame:
    """What changed_products gives over a finished table of polls, with windows: stamps that repeat their predecessor and differ from what was shown before."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("poll")
    runs = polls.withColumn("new", (F.col("stamp") != F.coalesce(F.lag("stamp").over(w), F.lit(""))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("path", "run").agg(F.first("stamp").alias("stamp"), F.count("*").alias("n"))
    r = Window.partitionBy("path").orderBy("run")
    settled = runs.where((F.col("n") > 1) | (F.col("run") == 1)).withColumn("before", F.lag("stamp").over(r))
    return settled.where("before is not null and stamp <> before").select("path", "stamp")
