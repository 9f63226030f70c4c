"""Steps in time: nearest matches without a cross join, interpolation between steps, series of products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, t: str = "t", by: Sequence[str] = (), columns: Sequence[str] = (), later: bool = False, tolerance: float | None = None) -> DataFrame:
    """Each row of left with the nearest row of right in time (columns and `t_right`, `dt`), within `by` groups.

    Both sides are laid in one order and each left row takes the last right row
    before it and the first after it from two running windows, so no pairs are
    made. Ties between before and after go to the earlier row, or to the later
    one on request; of right rows at one time, the largest columns are taken
    before a row and the smallest after it. A
    NULL time matches nothing. Without `by`, rows are cut into ranges of time
    first and a range's edges are carried over, so that no task sees all.
    """
    spark = left.sparkSession
    keep = [c for c in left.columns if c not in (t, *by)]
    cols = list(columns) or [c for c in right.columns if c not in (t, *by)]
    hit = F.struct(F.col(t).cast("double").alias("t"), *(F.col(c) for c in cols))
    one = left.select(*by, F.col(t).cast("double").alias("_t"), F.struct(*keep, F.col(t).alias(t)).alias("_l"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("_r"))
    two = right.where(F.col(t).isNotNull()).select(*by, F.col(t).cast("double").alias("_t"), F.lit(None).cast(one.schema["_l"].dataType).alias("_l"), hit.alias("_r"))
    both = one.unionByName(two)
    if by:
        keys = list(by)
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = both.repartitionByRange(n, "_t").withColumn("_part", F.spark_partition_id())
        keys = ["_part"]
    span = (Window.unboundedPreceding, Window.currentRow)
    # Rows of one time see each other in both directions: range frames end with the last peer.
    peers = Window.partitionBy(*keys).orderBy("_t").rangeBetween(*span)
    after = Window.partitionBy(*keys).orderBy(F.desc("_t")).rangeBetween(*span)
    found = both.withColumn("_before", F.max("_r").over(peers)).withColumn("_after", F.min("_r").over(after))
    if not by:
        edge = both.groupBy("_part").agg(F.max("_r").alias("hi"), F.min("_r").alias("lo"))
        order = Window.orderBy("_part")
        edge = edge.select("_part", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi"), F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_lo"))
        found = found.join(edge, "_part").withColumn("_before", F.coalesce("_before", "_hi")).withColumn("_after", F.coalesce("_after", "_lo"))
    found = found.where("_l is not null")
    down, up = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    take_after = (up <= down) if later else (up < down)
    best = F.when(F.col("_t").isNull(), None).when(F.col("_before").isNull() | take_after, F.col("_after")).otherwise(F.col("_before"))
    best = F.coalesce(best, F.when(F.col("_t").isNotNull(), F.coalesce("_before", "_after")))
    dt = F.abs(F.col("_m.t") - F.col("_t"))
    out = found.withColumn("_m", best)
    if tolerance is not None:
        out = out.withColumn("_m", F.when(dt <= tolerance, F.col("_m")))
    return out.select(*by, F.col(f"_l.{t}").alias(t), *(F.col(f"_l.{c}").alias(c) for c in keep), F.col("_m.t").alias("t_right"), dt.alias("dt"), *(F.col(f"_m.{c}").alias(c if c not in (t, *keep, *by) else f"{c}_right") for c in cols))


def interpolate(cube: DataFrame, step: str, sub: int, stride: int = 1, by: Sequence[str] = ("y", "x"), v: str = "v") -> DataFrame:
    """`sub` frames from each step to the one `stride` on: (by, frame, v), linear; (n - 1) sub + 1 frames. NULL if either end is."""
    w = Window.partitionBy(*by).orderBy(step)
    number = F.row_number().over(w) - 1
    rows = cube.select(*by, number.alias("_k"), F.col(v).alias("_v"), F.lead(v, stride).over(w).alias("_next"), F.lead(step, stride).over(w).isNotNull().alias("_more"))
    rows = rows.where(F.col("_k") % stride == 0)
    frames = F.when(F.col("_more"), F.sequence(F.lit(0), F.lit(sub - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_f", F.explode(frames))
    part = F.col("_f") / F.lit(float(sub))
    value = F.when(F.col("_f") == 0, F.col("_v")).otherwise(F.col("_v") * (1 - part) + F.col("_next") * part)
    return rows.select(*by, (F.floor(F.col("_k") / stride) * sub + F.col("_f")).cast("long").alias("frame"), value.alias(v))


def series(products: DataFrame, t: str = "t", path: str = "path", then: Sequence[str] = ()) -> DataFrame:
    """Products as numbered steps: by time, then path, then the columns `then`, unknown ones last. For catalogs (thousands of rows), which one task numbers."""
    return products.withColumn("step", F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_last() for c in (t, path, *then)))) - 1)


def strided(df: DataFrame, step: str, first: int, last: int, stride: int = 1) -> DataFrame:
    """The steps of first:last:stride, the last included."""
    return df.where((F.col(step) >= first) & (F.col(step) <= last) & ((F.col(step) - first) % stride == 0))


def step_label(t_text: Column, name: Column, step: Column) -> Column:
    """A step's label: its time, else its name, else its number from 1."""
    return F.coalesce(t_text, name, F.concat(F.lit("step "), (step + 1).cast("string")))


def same_display_ranges(layers: DataFrame, key: str = "display_key") -> DataFrame:
    """Union of the ranges (lo, hi) of layers with one display key."""
    return layers.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
