"""Images without an affine map: places from a grid of nodes, and pixels from places.

A grid holds the place of nodes that lie evenly over the image; between them it is
bilinear. Longitudes run on over 180 degrees, so that neighbours are neighbours. The
grid is small whatever the image, so it goes along with the function to the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of a side at most, and the error in pixels that needs no finer grid.
MOST_NODES, LEAST_ERROR = 257, 0.05


def continued(lon: np.ndarray, axis: int = -1) -> np.ndarray:
    """Longitudes that follow one another along an axis by less than 180 degrees; places unknown in between break the run."""
    step = np.diff(lon, axis=axis, prepend=np.take(lon, [0], axis))
    turns = np.where(np.isfinite(step), np.round(step / 360), 0)
    return lon - 360 * np.cumsum(turns, axis=axis)


def unwrapped(df: DataFrame, lon: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `lon` running on along each line: the sum of the turns so far is taken off."""
    w = Window.partitionBy(*by).orderBy(order)
    turn = F.coalesce(F.round((F.col(lon) - F.lag(lon).over(w)) / 360), F.lit(0.0))
    return df.withColumn("_turn", turn).withColumn(lon, F.col(lon) - 360 * F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def centre_values(nodes: Column, factor: int) -> Column:
    """Coordinates at the pixel centres of a level `factor` coarser, from an array of those at the pixels: between the two about the centre; at the end, the last."""
    size = F.size(nodes)
    at = lambda k: F.get(nodes, F.least(size - 1, F.greatest(F.lit(0), k)))

    def value(k: Column) -> Column:
        centre = k * factor + (factor - 1) / 2
        low = F.floor(centre).cast("int")
        return at(low) + (at(low + 1) - at(low)) * (centre - low)

    return F.transform(F.sequence(F.lit(0), F.ceil(size / factor).cast("int") - 1), value)


@dataclass
class Nodes:
    """x and y of the nodes (rows, columns) over an image of a width and height in pixels."""

    x: np.ndarray
    y: np.ndarray
    width: float
    height: float

    @staticmethod
    def of_arrays(lon: np.ndarray, lat: np.ndarray, most: int = 256) -> Nodes:
        """From coordinates of every pixel centre (two rows and columns at least): every k-th and the last of them. Positions count from the first centre."""
        take = [np.unique(np.append(np.arange(0, n, max(1, -(-n // most))), n - 1)) for n in lon.shape]
        # Even nodes from uneven ones: the last step may be shorter.
        even = [np.linspace(0, n - 1, len(t)) for n, t in zip(lon.shape, take)]
        lon, lat = continued(continued(lon, 0), 1)[np.ix_(*take)], lat[np.ix_(*take)]
        for axis in (0, 1):
            lon, lat = (np.apply_along_axis(lambda v, a=axis: np.interp(even[a], take[a], v), axis, z) for z in (lon, lat))
        return Nodes(lon, lat, float(even[1][-1]), float(even[0][-1]))

    @staticmethod
    def of_function(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: float, height: float, longitude: bool = False) -> Nodes:
        """From a map of pixel positions: as many nodes as make the error in the middle of cells small."""
        n = 2
        while True:
            c, r = np.meshgrid(np.linspace(0, width, n), np.linspace(0, height, n))
            x, y = (np.asarray(v, float) for v in f(c, r))
            out = Nodes(continued(continued(x, 0), 1) if longitude else x, y, width, height)
            mid = [(np.arange(n - 1) + 0.5) * size / (n - 1) for size in (width, height)]
            c, r = (v.ravel() for v in np.meshgrid(*mid))
            (ex, ey), (gx, gy) = f(c, r), out.at(c, r)
            dx = ex - gx
            if longitude:
                dx = (dx + 180) % 360 - 180
            error = np.nanmax(np.hypot(dx, ey - gy), initial=0) / max(out.pixel_size(), 1e-12)
            if error < LEAST_ERROR or n >= MOST_NODES:
                return out
            n = 2 * n - 1

    def _cell(self, col, row):
        ny, nx = self.x.shape
        gx = np.clip(np.asarray(col, float) / self.width * (nx - 1), 0, nx - 1)
        gy = np.clip(np.asarray(row, float) / self.height * (ny - 1), 0, ny - 1)
        i, j = np.minimum(gx.astype(int), nx - 2), np.minimum(gy.astype(int), ny - 2)
        return i, j, gx - i, gy - j

    def at(self, col, row) -> tuple[np.ndarray, np.ndarray]:
        """The place of pixel positions; beyond the image, that of its edge."""
        i, j, tx, ty = self._cell(col, row)
        mixed = lambda v: (v[j, i] * (1 - tx) + v[j, i + 1] * tx) * (1 - ty) + (v[j + 1, i] * (1 - tx) + v[j + 1, i + 1] * tx) * ty
        return mixed(self.x), mixed(self.y)

    def pixel_size(self) -> float:
        """Units a pixel near the centre: the geometric mean of both directions."""
        c, r = self.width / 2, self.height / 2
        x, y = self.at([c, c + 1, c], [r, r, r + 1])
        return float(np.sqrt(np.hypot(x[1] - x[0], y[1] - y[0]) * np.hypot(x[2] - x[0], y[2] - y[0])))

    def repeats(self) -> bool:
        """Whether it is found again a turn further: it spans the globe or goes over the 180th meridian."""
        x, _ = self.at([0, self.width], [self.height / 2] * 2)
        return bool(abs(abs(x[1] - x[0]) - 360) < 1 or np.nanmin(self.x) < -180 or np.nanmax(self.x) > 180)

    def inverse(self, x, y, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """The pixel positions of places, NaN outside: Newton steps over the cells from the nearest of some nodes."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        ny, nx = self.x.shape
        js, is_ = (np.unique(np.linspace(0, n - 1, min(n, 17)).astype(int)) for n in (ny, nx))
        some = np.stack(np.meshgrid(js, is_, indexing="ij"), -1).reshape(-1, 2)
        sx, sy = self.x[some[:, 0], some[:, 1]], self.y[some[:, 0], some[:, 1]]
        far = (x[:, None] - sx) ** 2 + (y[:, None] - sy) ** 2
        near = np.where(np.isfinite(far), far, np.inf).argmin(axis=1)
        x, y = (np.where(np.isfinite(v), v, np.nan) for v in (x, y))
        row, col = some[near, 0] * self.height / (ny - 1), some[near, 1] * self.width / (nx - 1)
        cw, ch = self.width / (nx - 1), self.height / (ny - 1)
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                col, row = np.nan_to_num(col), np.nan_to_num(row)
                i, j, tx, ty = self._cell(col, row)
                slope = lambda v: (((v[j, i + 1] - v[j, i]) * (1 - ty) + (v[j + 1, i + 1] - v[j + 1, i]) * ty) / cw, ((v[j + 1, i] - v[j, i]) * (1 - tx) + (v[j + 1, i + 1] - v[j, i + 1]) * tx) / ch)
                (xc, xr), (yc, yr) = slope(self.x), slope(self.y)
                gx, gy = self.at(col, row)
                ex, ey, det = x - gx, y - gy, xc * yr - xr * yc
                # A step may leave the image by a cell, so that the edge itself is found.
                col = np.clip(col + (ex * yr - ey * xr) / det, -cw, self.width + cw)
                row = np.clip(row + (ey * xc - ex * yc) / det, -ch, self.height + ch)
            gx, gy = self.at(np.nan_to_num(col), np.nan_to_num(row))
            good = (np.hypot(x - gx, y - gy) < 1e-6 * max(self.pixel_size(), 1e-12) + 1e-9 * (np.abs(x) + np.abs(y)))
            inside = good & (col >= -1e-9) & (col <= self.width + 1e-9) & (row >= -1e-9) & (row <= self.height + 1e-9)
        return np.where(inside, np.clip(col, 0, self.width), np.nan), np.where(inside, np.clip(row, 0, self.height), np.nan)


def _mapped(df: DataFrame, names: tuple[str, str], out: tuple[str, str], f: Callable) -> DataFrame:
    """df with two more columns that f makes of two; NULL where f knows none."""
    schema = df.select("*", F.lit(None).cast("double").alias(out[0]), F.lit(None).cast("double").alias(out[1])).schema

    def run(batches):
        for b in batches:
            a, z = (b.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names)
            found = f(a, z) if b.num_rows else (a, z)
            extra = [pa.array(np.asarray(v, float), pa.float64(), mask=~np.isfinite(v)) for v in found]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *out])

    return df.mapInArrow(run, schema)


def placed(df: DataFrame, nodes: Nodes, col: str = "col", row: str = "row") -> DataFrame:
    """df with `px`, `py`: the places of its pixel positions."""
    return _mapped(df, (col, row), ("px", "py"), nodes.at)


def located(df: DataFrame, nodes: Nodes, x: str = "x", y: str = "y") -> DataFrame:
    """df with `col`, `row`: the pixel positions of its places, NULL outside the image."""
    return _mapped(df, (x, y), ("col", "row"), nodes.inverse)


def corners(kind: str, text: str) -> list[tuple[float, float]] | None:
    """(lon, lat) of four corners in 15 characters each: kind G has ddmmssNdddmmssE, D decimal degrees in 7 and 8; None if they are too short or of another kind."""
    if len(text) < 60 or kind not in "GD" or not kind:
        return None

    def degrees(part: str) -> float:
        if kind == "D":
            return float(part)
        size = int(part[:-5]) + int(part[-5:-3]) / 60 + int(part[-3:-1]) / 3600
        return -size if part[-1] in "SW" else size

    try:
        return [(degrees(text[k + 7 : k + 15]), degrees(text[k : k + 7])) for k in range(0, 60, 15)]
    except ValueError:
        return None
