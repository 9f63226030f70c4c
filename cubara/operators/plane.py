"""Planes of pixels and what is computed from them.

A cube is a DataFrame of cells: one column a dimension and `v`, NULL for no
data. A Plane is a cube's (y, x, v) at one index of every other dimension, with
its Grid. Everything is a lazy plan: Catalyst prunes columns, pushes filters to
the scan and combines aggregates before a shuffle.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubara.functions import expression, geo
from cubara.functions import nodata as N

#: The aggregates, all over known values only; Count has no unit.
AGGREGATES = {
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "count": lambda v: F.count(v).cast("double"),
}


class GridError(ValueError):
    pass


def steady_mean(v: Column) -> Column:
    """The mean of the known, finite values, the same in whatever order the rows come.

    A plain sum's last bits depend on the order of rows, and what is cut into steps
    then may be one step off. Values are split into multiples of 2^-8, of 2^-34 and
    a rest: sums of the first are exact up to 2^45, of the second for 2^28 rows, and
    the rest's errors are too small to be seen in the mean.
    """
    cut = lambda x, k: F.rint(x * F.lit(2.0**k)) / F.lit(2.0**k)
    high = F.when(F.abs(v) < F.lit(2.0**45), cut(v, 8)).otherwise(v)
    middle = cut(v - high, 34)
    return (F.sum(high) + (F.sum(middle) + F.sum(v - high - middle))) / F.count(v)


@dataclass(frozen=True)
class Grid:
    """Size and place of a plane; None where unknown."""

    width: int | None = None
    height: int | None = None
    gt: tuple[float, ...] | None = None
    epsg: int | None = None

    def same(self, other: Grid) -> bool:
        return (self.width, self.height, self.epsg) == (other.width, other.height, other.epsg) and (self.gt == other.gt or bool(self.gt and other.gt and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(self.gt, other.gt))))

    def coarse(self, f: int) -> Grid:
        up = lambda n: None if n is None else -(-n // f)
        return replace(self, width=up(self.width), height=up(self.height), gt=tuple(geo.window_affine(self.gt, 0, 0, f)) if self.gt else None)


def axes_proposal(dims: Sequence[str]) -> tuple[str, str]:
    """The row and column dimensions by their names (a leading dim_ is ignored), else the last two."""
    plain = [d.lower().removeprefix("dim_") for d in dims]
    # The known names of rows and of columns.
    rows = ("lat", "latitude", "y", "row", "rows", "line", "lines", "scanline", "along_track", "alt", "nrows")
    cols = ("lon", "longitude", "x", "col", "cols", "column", "columns", "pixel", "pixels", "ground_pixel", "across_track", "act", "ncols")
    y = next((k for k, d in enumerate(plain) if d in rows), None)
    x = next((k for k, d in enumerate(plain) if d in cols), None)
    if y is None or x is None:
        return dims[-2], dims[-1]
    return dims[y], dims[x]


@dataclass(frozen=True)
class Plane:
    """(y, x, v) with its grid, units and name."""

    df: DataFrame
    grid: Grid = field(default_factory=Grid)
    units: str = ""
    name: str = ""
    #: (DataFrame of several planes, this one's column there, df as it was taken from it): see planes().
    origin: tuple | None = None

    # -- reading

    def window(self, col0: int, row0: int, width: int, height: int) -> Plane:
        """The pixels of a window; one that isn't inside a plane of known size is an error."""
        if width < 1 or height < 1 or col0 < 0 or row0 < 0 or (self.grid.width is not None and col0 + width > self.grid.width) or (self.grid.height is not None and row0 + height > self.grid.height):
            raise GridError(f"the window {col0},{row0} {width}x{height} isn't inside {self.grid.width}x{self.grid.height}")
        inside = F.col("y").between(row0, row0 + height - 1) & F.col("x").between(col0, col0 + width - 1)
        gt = tuple(geo.window_affine(self.grid.gt, col0, row0)) if self.grid.gt else None
        return replace(self, df=self.df.where(inside), grid=replace(self.grid, width=width, height=height, gt=gt))

    def probe(self, col: int, row: int) -> DataFrame:
        """The value at one pixel; the filter reaches the scan through whatever computed the plane."""
        return self.df.where((F.col("y") == row) & (F.col("x") == col)).select("v")

    def located(self) -> DataFrame:
        """y, x, v and the map position px, py of each pixel's centre."""
        if not self.grid.gt:
            raise GridError("the plane has no map position")
        px, py = geo.affine(self.grid.gt, F.col("x") + 0.5, F.col("y") + 0.5)
        return self.df.select("y", "x", "v", px.alias("px"), py.alias("py"))

    def strided(self, most: int = 4 << 20) -> Plane:
        """Every s-th row and column, s the least that leaves `most` pixels: for figures of a large region where an exact one isn't asked for."""
        total = (self.grid.width or 0) * (self.grid.height or 0)
        s = math.ceil(math.sqrt(total / most)) if total > most else 1
        return self if s == 1 else replace(self, df=self.df.where((F.col("y") % s == 0) & (F.col("x") % s == 0)))

    # -- levels

    def coarsen(self, f: int) -> Plane:
        """Means of the known values of f x f pixels; blocks at the edge are partial, blocks without values NULL."""
        if f < 1:
            raise GridError(f"no factor {f}")
        block = lambda c: F.floor(F.col(c) / f).cast("long").alias(c)
        df = self.df.groupBy(block("y"), block("x")).agg(F.avg("v").alias("v"))
        return replace(self, df=df, grid=self.grid.coarse(f))

    # -- statistics

    def region(self, points: Sequence[tuple[float, float]], located: bool = False) -> DataFrame:
        """The pixels whose centres lie in a polygon (of pixel or map positions); its bounds are a filter that the scan sees."""
        x0, y0, x1, y1 = geo.bounds(points)
        if located:
            df, x, y = self.located(), F.col("px"), F.col("py")
        else:
            df, x, y = self.df, F.col("x") + 0.5, F.col("y") + 0.5
            df = df.where(F.col("x").between(math.floor(x0), math.ceil(x1)) & F.col("y").between(math.floor(y0), math.ceil(y1)))
        return df.where(x.between(x0, x1) & y.between(y0, y1) & geo.inside(points, x, y))

    def masked(self, points: Sequence[tuple[float, float]], located: bool = False) -> Plane:
        """The plane with NULL where a pixel's centre is outside the polygon."""
        if located:
            df = self.located()
            return replace(self, df=df.select("y", "x", F.when(geo.inside(points, F.col("px"), F.col("py")), F.col("v")).alias("v")))
        return replace(self, df=self.df.select("y", "x", F.when(geo.inside(points, F.col("x") + 0.5, F.col("y") + 0.5), F.col("v")).alias("v")))

    def statistics(self, points: Sequence[tuple[float, float]] | None = None, located: bool = False) -> DataFrame:
        """n, mean, std (population), min, max of the known values; NULLs if there is none."""
        return statistics(self.df if points is None else self.region(points, located))

    def zonal(self) -> DataFrame:
        """(y, v): the mean of each row's known values."""
        return self.df.groupBy("y").agg(F.avg("v").alias("v"))

    def meridional(self) -> DataFrame:
        """(x, v): the mean of each column's known values."""
        return self.df.groupBy("x").agg(F.avg("v").alias("v"))

    def with_expression(self, text: str) -> Plane:
        """An expression of the plane's own values, as `v`."""
        return replace(self, df=self.df.select("y", "x", expression.compile_expression(text, {"v": F.col("v")}).alias("v")))

    def to_numpy(self):
        """The window as an array of float64 with NaN for no data; for small ones, the rows are collected."""
        import numpy as np

        if self.grid.width is None or self.grid.height is None:
            raise GridError("the plane's size is unknown")
        got = self.df.where("v is not null").toPandas()
        out = np.full((self.grid.height, self.grid.width), np.nan)
        out[got["y"].to_numpy(int), got["x"].to_numpy(int)] = got["v"]
        return out


def statistics(df: DataFrame, v: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std, min, max of known values, in all or by columns."""
    c = F.col(v)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


# -- selection and aggregates of cubes


def pick(cube: DataFrame, y: str, x: str, at: Mapping[str, int] | None = None, sizes: Mapping[str, int] | None = None, grid: Grid | None = None, **info) -> Plane:
    """A plane from any two dimensions, at an index of each other one (0 where none is given; too large ones are the last)."""
    others = [c for c in cube.columns if c not in (y, x, "v")]
    df = cube
    for d in others:
        k = (at or {}).get(d, 0)
        if sizes and d in sizes:
            k = max(0, min(k, sizes[d] - 1))
        df = df.where(F.col(d) == k)
    return Plane(df.select(F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"), F.col("v")), grid or Grid(), **info)


def aggregate(cube: DataFrame, along: str, how: str, first: int | None = None, last: int | None = None, keep: Sequence[str] | None = None, v: str = "v") -> DataFrame:
    """The aggregate of `v` along a dimension, by all others; first and last bound it in either order. Cells without known values are NULL, or 0 for count."""
    if how not in AGGREGATES:
        raise ValueError(f"no aggregate {how!r}: {', '.join(AGGREGATES)}")
    if first is not None and last is not None:
        cube = cube.where(F.col(along).between(min(first, last), max(first, last)))
    by = list(keep) if keep is not None else [c for c in cube.columns if c not in (along, v)]
    return cube.groupBy(*by).agg(AGGREGATES[how](F.col(v)).alias(v))


def aggregate_units(how: str, units: str) -> str:
    """The units of an aggregate: a count has none."""
    return "" if how == "count" else units


def profile(cube: DataFrame, along: str, at: Mapping[str, int]) -> DataFrame:
    """(along, v) at one index of each other dimension, in order."""
    if along in ("y", "x"):
        raise ValueError("a profile runs along a dimension that isn't an image axis")
    df = cube
    for d, k in at.items():
        df = df.where(F.col(d) == k)
    return df.select(along, "v").orderBy(along)


# -- layers


def planes(stack: DataFrame, bands: Sequence[str], grid: Grid = Grid(), units: str = "") -> list[Plane]:
    """Planes of the columns `bands` of one DataFrame (y, x, bands, and has_<band> where a pixel may be missing from one): together they are read once."""
    has = lambda b: F.col(f"has_{b}") if f"has_{b}" in stack.columns else F.lit(True)
    out = []
    for b in bands:
        df = stack.where(has(b)).select("y", "x", F.col(b).alias("v"))
        out.append(Plane(df, grid, units, b, (stack, b, df)))
    return out


def side_by_side(layers: Sequence[Plane], how: str = "inner") -> DataFrame:
    """(y, x, v0, v1, ...): the pixels of several planes of one grid; planes of one DataFrame are read once."""
    if not layers:
        raise ValueError("no layer")
    if not all(p.grid.same(layers[0].grid) for p in layers):
        raise GridError("the layers have different grids")
    of = [p.origin if p.origin and p.origin[2] is p.df else (None, "", None) for p in layers]
    if of[0][0] is not None and all(o[0] is of[0][0] for o in of):
        stack, bands = of[0][0], [o[1] for o in of]
        marks = [F.col(f"has_{b}") if f"has_{b}" in stack.columns else F.lit(True) for b in bands]
        keep = functools.reduce(lambda x, y: x & y if how == "inner" else x | y, marks)
        return stack.where(keep).select("y", "x", *(F.col(b).alias(f"v{k}") for k, b in enumerate(bands)))
    held: dict[int, int] = {}
    out: DataFrame | None = None
    for k, p in enumerate(layers):
        if (first := held.setdefault(id(p.df), k)) != k:
            out = out.withColumn(f"v{k}", F.col(f"v{first}"))
            continue
        one = p.df.select("y", "x", F.col("v").alias(f"v{k}"))
        out = one if out is None else out.join(one, ["y", "x"], how)
    return out


def layer_math(text: str, layers: Mapping[str, Plane], strict: bool = False, units: str | None = None, finite: bool = True) -> Plane:
    """An expression over the same pixels of several planes; all must have one grid. Layers of one DataFrame are read once. strict, finite: see compile_expression()."""
    if not layers:
        raise ValueError("no layer")
    grid = next(iter(layers.values())).grid
    if not all(p.grid.same(grid) for p in layers.values()):
        raise GridError("the layers have different grids")
    used = expression.parse(text, list(layers)).names() or list(layers)[:1]
    joined = side_by_side([layers[n] for n in used])
    value = expression.compile_expression(text, {n: F.col(f"v{k}") for k, n in enumerate(used)}, strict, finite)
    of = {layers[n].units for n in used}
    return Plane(joined.select("y", "x", value.alias("v")), grid, units if units is not None else (of.pop() if len(of) == 1 else ""), text)


def mask_where(plane: Plane, mask: DataFrame, inside: bool = True) -> Plane:
    """The plane's pixels that are (or aren't) among the pixels (y, x) of mask: a semi or anti join."""
    return replace(plane, df=plane.df.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi" if inside else "left_anti"))


def blend(a: Plane, b: Plane, share: float) -> DataFrame:
    """share of b over the rest of a; a pixel known in one only shows that one. Flickering is share 0 and 1 in turn."""
    return stack_over([(a, 1.0), (b, share)])


def box_mean(df: DataFrame, radius: int, known: int = 1) -> DataFrame:
    """(y, x, v): unknown pixels filled by the mean of the known ones in the box of 2 radius + 1 pixels around, if at least `known` are; others as they are.

    Sums run over columns, then over rows, as range windows of whole lines.
    """
    value = F.col("v").cast("double")
    row = Window.partitionBy("y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy("x").orderBy("y").rangeBetween(-radius, radius)
    across = df.select("y", "x", "v", F.sum(value).over(row).alias("s"), F.count("v").over(row).alias("n"))
    both = across.select("y", "x", "v", F.sum("s").over(column).alias("s"), F.sum("n").over(column).alias("n"))
    return both.select("y", "x", F.coalesce(value, F.when(F.col("n") >= known, F.col("s") / F.col("n"))).alias("v"))


def value_sample(df: DataFrame, width: int, height: int, most: int = 65_536) -> DataFrame:
    """About `most` pixels at places that depend on the grid's size only: every k-th of the pixels in row order."""
    k = max(1, -(-width * height // most))
    return df.where((F.col("y") * F.lit(width) + F.col("x")) % k == 0)


def values_window(plane: Plane, row: int, column: int, rows: int = 9, columns: int = 15) -> DataFrame:
    """(y, values): the values of a window of the plane as rows of a table, with NULL where there is no pixel; unknown sizes are not clamped."""
    g = plane.grid
    top = row if g.height is None else max(0, min(row, g.height - rows))
    left = column if g.width is None else max(0, min(column, g.width - columns))
    near = plane.df.where(F.col("y").between(top, top + rows - 1) & F.col("x").between(left, left + columns - 1))
    cells = [F.max(F.when(F.col("x") == left + k, F.col("v"))).alias(f"c{k}") for k in range(columns)]
    lines = plane.df.sparkSession.range(top, top + rows).toDF("y")
    return lines.join(near.groupBy("y").agg(*cells), "y", "left").select("y", F.array(*(f"c{k}" for k in range(columns))).alias("values"))


def check_size(n_values: int, size: int = 8, memory: int | None = None) -> None:
    """Refuse a window of over a quarter of the memory (of the driver, by its setting, if none is given)."""
    import os

    memory = memory or os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    if n_values * size > memory // 4:
        raise ValueError(f"{n_values * size / 1e9:.1f} GB are over a quarter of the memory: choose a smaller window or a coarser level")


#: Of two layers a and b.
COMPARISONS = {"difference": "a - b", "ratio": "a / b", "db": "10 * log10(a / b)", "percent": "100 * (a - b) / b"}


def compare(a: Plane, b: Plane, how: str, finite: bool = True) -> Plane:
    """Difference, ratio, ratio in dB or percent of two planes. What is not finite is no data, as it is shown; not finite: it stays, as SQL has it."""
    return layer_math(COMPARISONS[how], {"a": a, "b": b}, strict=True, finite=finite)


def difference_range(how: str, lo: float, hi: float) -> tuple[float, float]:
    """The range a comparison is shown over at first."""
    half = max(abs(lo), abs(hi)) / 2
    return {"difference": (-half, half), "ratio": (0.0, 2.0), "db": (-6.0, 6.0), "percent": (-50.0, 50.0)}[how]


def swipe(a: Plane, b: Plane, at: int) -> DataFrame:
    """a left of column `at`, b from there on; a pixel of one plane only is unknown on the other's side."""
    both = side_by_side([a, b], "full")
    return both.select("y", "x", F.when(F.col("x") < at, F.col("v0")).otherwise(F.col("v1")).alias("v"))


def stack_over(layers: Sequence[tuple[Plane, float]]) -> DataFrame:
    """Layers with opacities, the last on top: each is laid over what is below; a pixel without data, or missing from a layer, shows what is below."""
    out = side_by_side([p for p, _ in layers], "full").withColumn("v", F.col("v0"))
    for k, (_, alpha) in enumerate(layers[1:], 1):
        top = F.col(f"v{k}")
        out = out.withColumn("v", F.when(top.isNull(), F.col("v")).when(F.col("v").isNull(), top).otherwise(top * alpha + F.col("v") * (1 - alpha)))
    return out.select("y", "x", "v")


def rgb(r: Plane, g: Plane, b: Plane, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """y, x, r, g, b in 0..255: each channel stretched over its range, no data and missing pixels as 0."""
    df = side_by_side([r, g, b], "full")
    shade = lambda c, k, lo, hi: F.floor(F.coalesce(N.stretch(F.col(f"v{k}"), lo, hi), F.lit(0.0)) * 255 + 0.5).cast("int").alias(c)
    return df.select("y", "x", *(shade(c, k, *lim) for k, (c, lim) in enumerate(zip("rgb", ranges))))


# -- distributions


def histogram(df: DataFrame, lo: float, hi: float, bins: int = 128, v: str = "v") -> DataFrame:
    """(bin, n, share): counts of known values in equal bins, empty ones too. Positions are cut towards zero, so the right edge is out; share is in percent of all that is counted."""
    place = ((F.col(v) - F.lit(float(lo))) / F.lit(float(hi - lo)) * bins).cast("long")
    counted = df.where(F.col(v).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin").between(0, bins - 1))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    out = every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


#: Ranges that approximate quantiles cut the values into: a power of two of _STEP.
_STEP = 16
_RANGES = _STEP * _STEP


def quantile(df: DataFrame, p: float, v: str = "v") -> DataFrame:
    """(q): the value at place floor((n - 1) p) of the sorted known values, whole: not interpolated.

    Distinct values are counted within ranges between approximate quantiles (found
    when this is called). Sums over the ranges tell which one holds the place, and
    only its distinct values, about a 256th of all, are put in order.
    """
    known = df.where(F.col(v).isNotNull()).select(F.col(v).alias("q"))
    edges = known.agg(F.percentile_approx("q", [k / _RANGES for k in range(1, _RANGES)], 40 * _RANGES)).first()[0]
    ends = sorted(set(edges or ()))
    literal = lambda x: F.lit(x) if x else F.array().cast(f"array<{dict(known.dtypes)['q']}>")
    under = lambda a: F.size(F.filter(a, lambda e: e < F.col("q")))
    first = under(literal(ends[_STEP - 1 :: _STEP])) * _STEP
    part = F.transform(F.array(first), lambda f: f + under(F.slice(literal(ends), f + 1, F.lit(_STEP))))[0]
    counts = known.groupBy("q").agg(F.count("*").alias("n")).withColumn("part", part)
    sums = counts.groupBy("part").agg(F.sum("n").alias("n"))
    order = Window.orderBy("part")
    sums = sums.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"), "n", F.floor((F.sum("n").over(Window.partitionBy()) - 1) * F.lit(p)).alias("place"))
    holds = sums.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).select("part", "before", "place")
    inside = counts.join(F.broadcast(holds), "part")
    upto = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("q")))
    return upto.where(F.col("place") < F.col("upto")).agg(F.min("q").alias("q")).where("q is not null")


def scatter_bins(pairs: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float], bins: int = 200, x: str = "a", y: str = "b") -> DataFrame:
    """(i, j, n): pairs by bin of two ranges, j from the top; pairs outside have no bin."""
    i = F.floor((F.col(x) - xlim[0]) / F.lit(float(xlim[1] - xlim[0])) * bins)
    j = F.floor((F.col(y) - ylim[0]) / F.lit(float(ylim[1] - ylim[0])) * bins)
    inside = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(i.cast("long").alias("i"), (F.lit(bins - 1) - j).cast("long").alias("j")).where(F.col("i").between(0, bins - 1) & F.col("j").between(0, bins - 1))
    return inside.groupBy("i", "j").agg(F.count("*").alias("n"))


def scatter_statistics(pairs: DataFrame, x: str = "a", y: str = "b") -> DataFrame:
    """n, r (Pearson), bias (mean of y - x) and rmsd over all pairs that are known on both sides."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = F.col(y) - F.col(x)
    return both.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmsd"))


# -- lines


def transect(plane: Plane, a: tuple[float, float], b: tuple[float, float], n: int | None = None) -> DataFrame:
    """(k, x, y, v): n values along a line of pixel positions (else one a pixel of its length, 2 to 2000), from the pixel that holds each point; NULL outside."""
    n = n or max(2, min(2000, math.ceil(math.hypot(b[0] - a[0], b[1] - a[1])) + 1))
    part = F.col("id") / F.lit(float(n - 1))
    at = lambda p, q: F.floor(F.lit(float(p)) + part * F.lit(float(q - p))).cast("long")
    points = plane.df.sparkSession.range(n).select(F.col("id").alias("k"), at(a[0], b[0]).alias("x"), at(a[1], b[1]).alias("y"))
    x0, x1, y0, y1 = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
    near = plane.df.where(F.col("x").between(math.floor(x0), math.floor(x1)) & F.col("y").between(math.floor(y0), math.floor(y1)))
    return points.join(near, ["x", "y"], "left").select("k", "x", "y", "v")


def line_distance(points: DataFrame, order: str = "k", lon: str = "lon", lat: str = "lat", by: Sequence[str] = ()) -> DataFrame:
    """The points with `distance`: great-circle meters from the line's first point, along it."""
    w = Window.partitionBy(*by).orderBy(order)
    step = geo.haversine(F.lag(lon).over(w), F.lag(lat).over(w), F.col(lon), F.col(lat))
    return points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def polyline(plane: Plane, points: Sequence[tuple[float, float]], most: int = 100_000) -> DataFrame:
    """(k, x, y, v): values along a polyline of pixel positions: a point a pixel of each segment's length, 1 to `most`, and the last point."""
    spark = plane.df.sparkSession
    segments, at = [], 0
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        n = max(1, min(most, math.ceil(math.hypot(bx - ax, by - ay))))
        segments.append((at, n, float(ax), float(ay), float(bx), float(by)))
        at += n
    lx, ly = map(float, points[-1])
    segments.append((at, 1, lx, ly, lx, ly))
    lines = spark.createDataFrame(segments, "first long, n int, ax double, ay double, bx double, by double").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    part = F.col("j") / F.col("n")
    spot = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * part).cast("long")
    spots = lines.select((F.col("first") + F.col("j")).alias("k"), spot("ax", "bx").alias("x"), spot("ay", "by").alias("y"))
    xs, ys = [x for x, _ in points], [y for _, y in points]
    near = plane.df.where(F.col("x").between(math.floor(min(xs)), math.floor(max(xs))) & F.col("y").between(math.floor(min(ys)), math.floor(max(ys))))
    return spots.join(near, ["x", "y"], "left").select("k", "x", "y", "v")


# -- pyramid


def pyramid(width: int, height: int, files: Sequence[tuple[int, int]] = (), least: int = 512, gap: float = 2.7) -> list[tuple[str, int, int]]:
    """(source, level or factor, width) of the levels shown: the file's own, halvings where the next is more than `gap` times smaller, and on until one is `least` or smaller.

    source is file (its index) or mean (the factor to the file level before).
    """
    sizes = [(width, height), *files]
    out = []
    for k, (w, h) in enumerate(sizes):
        out.append(("file", k, w))
        following = sizes[k + 1] if k + 1 < len(sizes) else None
        f = 2
        while True:
            cw, ch = -(-w // f), -(-h // f)
            if following:
                if w / f * 2 / following[0] <= gap or max(w, h) / f <= max(following):
                    break
            elif max(-(-2 * w // f), -(-2 * h // f)) <= least:
                break
            out.append(("mean", f, cw))
            del ch
            f *= 2
    return out


def level_for(widths: Sequence[float], wanted: float) -> int:
    """The coarsest level whose pixel (in one unit, finest first) is at most the wanted one, else the finest."""
    return max((k for k, w in enumerate(widths) if w <= wanted), default=0)


def tile_range(x0: float, y0: float, x1: float, y1: float, tile: int, width: int, height: int) -> tuple[int, int, int, int]:
    """First and last tile column, first and last tile row that a pixel box touches; ranges are empty (last before first) outside."""
    cut = lambda lo, hi, n: (max(0, math.floor(lo)) // tile, min(n, math.ceil(hi)) - 1) if hi > 0 and lo < n else (0, -1)
    (a, b), (c, d) = cut(min(x0, x1), max(x0, x1), width), cut(min(y0, y1), max(y0, y1), height)
    return a, b // tile if b >= 0 else -1, c, d // tile if d >= 0 else -1


def pixel_box(grid: Grid, box: tuple[float, float, float, float], to_grid=None, edge: int = 17) -> tuple[int, int, int, int] | None:
    """Pixels x0, y0, x1, y1 (ends excluded) that a rectangle of coordinates covers; None if it lies outside. to_grid: (x, y) of the rectangle's system to the grid's; edges are followed at `edge` points."""
    west, south, east, north = box
    part = [k / (edge - 1) for k in range(edge)]
    rim = [(west + (east - west) * t, y) for t in part for y in (south, north)] + [(x, south + (north - south) * t) for t in part for x in (west, east)]
    found = [q for p in rim if (q := to_grid(*p) if to_grid else p) is not None and all(map(math.isfinite, q))]
    if not found:
        return None
    ox, ax, bx, oy, ay, by = grid.gt
    det = ax * by - bx * ay
    spots = [(((x - ox) * by - (y - oy) * bx) / det, ((y - oy) * ax - (x - ox) * ay) / det) for x, y in found]
    x0, x1 = max(0, math.floor(min(c for c, _ in spots) + 1e-9)), min(grid.width, math.ceil(max(c for c, _ in spots) - 1e-9))
    y0, y1 = max(0, math.floor(min(r for _, r in spots) + 1e-9)), min(grid.height, math.ceil(max(r for _, r in spots) - 1e-9))
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def type_range(dtype: str, scale: float = 1.0, offset: float = 0.0) -> tuple[float, float] | None:
    """The range of values of an integer type of up to 32 bits, scaled, in order; None for others."""
    bits = {"u1": (0, 8), "i1": (1, 8), "u2": (0, 16), "i2": (1, 16), "u4": (0, 32), "i4": (1, 32)}.get(dtype.lstrip("<>|="))
    if not bits:
        return None
    signed, n = bits
    lo, hi = (-(1 << n - 1), (1 << n - 1) - 1) if signed else (0, (1 << n) - 1)
    return tuple(sorted((lo * scale + offset, hi * scale + offset)))
