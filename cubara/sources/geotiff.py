"""TIFF, BigTIFF and GeoTIFF (overviews included) as a data source of cells, and a GeoTIFF writer for planes.

`spark.read.format("geotiff").load(path)` gives (band, y, x, v); option `level` picks an
overview. A task reads a run of strips or tiles. Values equal to the no-data tag
and non-finite ones are NULL; the bands' own scale and offset are applied.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cubara.sources import codecs

# Fixed values of the format.
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KIND = {1: "u", 2: "i", 3: "f"}
_CODEC = {1: "raw", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits", 50000: "zstd"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_SIZES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SUBFILE, PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, META, NO_DATA = 254, 33550, 33922, 34264, 34735, 42112, 42113


@dataclass
class Image:
    width: int
    height: int
    bands: int
    dtype: str
    chunk: tuple[int, int]
    tiled: bool
    planar: bool
    codec: str
    predictor: int
    places: list = field(repr=False)
    gt: list | None = None
    epsg: int | None = None
    fill: float | None = None
    scales: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    names: list = field(default_factory=list)


def directories(path: str, most: int = 64) -> list[dict]:
    """Tags of each image of a file, with `order` and `mask`."""
    out = []
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        (version,) = struct.unpack_from(order + "H", head, 2)
        big = version == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
        while at and len(out) < most:
            f.seek(at)
            (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
            entry, tags = (20 if big else 12), {"order": order}
            body = f.read(n * entry + (8 if big else 4))
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), body, k * entry)
                form = _FIELD.get(kind)
                if form is None:
                    continue
                size = struct.calcsize("<" + form) * count
                place = k * entry + (12 if big else 8)
                raw = body[place : place + size]
                if size > (8 if big else 4):
                    (where,) = struct.unpack_from(order + ("Q" if big else "I"), body, place)
                    f.seek(where)
                    raw = f.read(size)
                tags[tag] = raw.rstrip(b"\0").decode("latin-1") if form == "s" else list(struct.unpack(order + form * count, raw))
            out.append(tags)
            (at,) = struct.unpack_from(order + ("Q" if big else "I"), body, n * entry)
    return out


def image(tags: dict) -> Image:
    order, first = tags["order"], lambda t, d=None: (tags.get(t) or [d])[0]
    bands = first(SAMPLES, 1)
    code = first(COMPRESSION, 1)
    if code not in _CODEC:
        raise ValueError(f"TIFF compression {code} isn't supported")
    tiled = TILES in tags
    width, height = first(WIDTH), first(HEIGHT)
    chunk = (first(TILE_H), first(TILE_W)) if tiled else (min(first(ROWS, height), height), width)
    places = list(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES]))
    out = Image(width, height, bands, f"{order}{_KIND[first(FORMAT, 1)]}{first(BITS, 1) // 8}", chunk, tiled, first(PLANAR, 1) == 2, _CODEC[code], first(PREDICTOR, 1), places)
    keys = tags.get(GEO_KEYS, [])
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    out.epsg = next((geo[k] for k in (3072, 2048) if k in geo and geo[k] != 32767), None)
    if MATRIX in tags:
        m = tags[MATRIX]
        out.gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:5]
        out.gt = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    if out.gt and geo.get(1025) == 2:  # positions are pixel centres
        g = out.gt
        out.gt = [g[0] - (g[1] + g[2]) / 2, g[1], g[2], g[3] - (g[4] + g[5]) / 2, g[4], g[5]]
    if NO_DATA in tags:
        out.fill = float(tags[NO_DATA].strip() or "nan")
    items = re.findall(r'<Item name="(\w+)" sample="(\d+)"[^>]*>([^<]*)<', tags.get(META, ""))
    own = {(n.upper(), int(s)): v for n, s, v in items}
    out.scales = [float(own.get(("SCALE", b), 1)) for b in range(bands)]
    out.offsets = [float(own.get(("OFFSET", b), 0)) for b in range(bands)]
    color = ["red", "green", "blue", "alpha"] if first(PHOTOMETRIC) in (2, 6) and bands >= 3 else []
    out.names = [own.get(("DESCRIPTION", b)) or (color[b] if b < len(color) else f"Band {b + 1}") for b in range(bands)]
    return out


def levels(path: str) -> list[Image]:
    """The image and its overviews: smaller images that aren't masks and have the same bands and type."""
    found = directories(path)
    first = image(found[0])
    out = [first]
    for tags in found[1:]:
        kind = (tags.get(SUBFILE) or [0])[0]
        if kind & 1 and not kind & 4:
            one = image(tags)
            if (one.bands, one.dtype) == (first.bands, first.dtype) and one.width < out[-1].width:
                one.gt = [first.gt[0], first.gt[1] * first.width / one.width, first.gt[2], first.gt[3], first.gt[4], first.gt[5] * first.height / one.height] if first.gt else None
                one.fill, one.scales, one.offsets, one.epsg, one.names = first.fill, first.scales, first.offsets, first.epsg, first.names
                out.append(one)
    return out


@dataclass
class Chunks(InputPartition):
    first: int
    last: int


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> StructType:
        return StructType([StructField("band", LongType(), False), StructField("y", LongType(), False), StructField("x", LongType(), False), StructField("v", DoubleType())])

    def reader(self, schema: StructType) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], levels(self.options["path"])[int(self.options.get("level", 0))])


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, one: Image):
        self.path, self.image = path, one
        self.across = -(-one.width // one.chunk[1])
        self.each = self.across * -(-one.height // one.chunk[0])

    def partitions(self) -> list[InputPartition]:
        step = max(1, (1 << 21) // (self.image.chunk[0] * self.image.chunk[1]))
        return [Chunks(k, min(k + step, len(self.image.places))) for k in range(0, len(self.image.places), step)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        im = self.image
        h, w = im.chunk
        inside = 1 if im.planar else im.bands
        with open(self.path, "rb") as f:
            for k in range(partition.first, partition.last):
                band0, place = (k // self.each, k % self.each) if im.planar else (0, k)
                y0, x0 = place // self.across * h, place % self.across * w
                rows, cols = min(h, im.height - y0), min(w, im.width - x0)
                high = h if im.tiled else rows
                offset, size = im.places[k]
                if size:
                    f.seek(offset)
                    data = codecs.decode(f.read(size), [(im.codec, {})])
                    data = codecs.predictor(data, im.predictor, w, inside, im.dtype)
                    stored = np.frombuffer(data, im.dtype, high * w * inside).reshape(high, w, inside)[:rows, :cols].astype(np.float64)
                else:
                    stored = np.full((rows, cols, inside), np.nan)
                y, x = np.indices((rows, cols))
                for b in range(inside):
                    value = stored[:, :, b].ravel()
                    none = ~np.isfinite(value) | (value == im.fill if im.fill is not None else False)
                    value = value * im.scales[band0 + b] + im.offsets[band0 + b]
                    n = len(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, band0 + b)), pa.array(y.ravel() + y0), pa.array(x.ravel() + x0), pa.array(value, mask=none)], names=["band", "y", "x", "v"])


def write_plane(plane, path: str, tile: int = 512) -> None:
    """A plane as a tiled GeoTIFF (32-bit floats, Deflate, NaN for no data; BigTIFF beyond 3.5 GB).

    Tiles are encoded by tasks, one group a tile, and come to the driver one
    after another in file order, which writes them: it holds one partition.
    """
    from pyspark.sql import functions as F

    width, height = plane.grid.width, plane.grid.height
    if not width or not height:
        raise ValueError("the plane's size is unknown")
    across, down = -(-width // tile), -(-height // tile)
    number = (F.floor(F.col("y") / tile) * across + F.floor(F.col("x") / tile)).cast("long")

    def encode(pdf):
        import pandas as pd

        a = np.full((tile, tile), np.nan, "<f4")
        a[(pdf["y"] % tile).to_numpy(int), (pdf["x"] % tile).to_numpy(int)] = pdf["v"].to_numpy("f4")
        return pd.DataFrame({"t": [int(pdf["t"].iloc[0])], "data": [zlib.compress(a.tobytes(), 6)]})

    done = plane.df.where("v is not null").select(number.alias("t"), "y", "x", F.col("v").cast("double").alias("v")).groupBy("t").applyInPandas(encode, "t long, data binary").orderBy("t")
    big = width * height * 4 > 3_500_000_000
    empty = zlib.compress(np.full((tile, tile), np.nan, "<f4").tobytes(), 6)
    places, sizes = [], []
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))

        def put(data: bytes) -> None:
            places.append(f.tell())
            sizes.append(len(data))
            f.write(data)

        for row in done.toLocalIterator():
            while len(places) < row["t"]:
                put(empty)
            put(bytes(row["data"]))
        while len(places) < across * down:
            put(empty)
        wide = ("Q", 16) if big else ("I", 4)
        tags = [(WIDTH, "I", 4, [width]), (HEIGHT, "I", 4, [height]), (BITS, "H", 3, [32]), (COMPRESSION, "H", 3, [8]), (PHOTOMETRIC, "H", 3, [1]), (SAMPLES, "H", 3, [1]), (PLANAR, "H", 3, [1]), (TILE_W, "I", 4, [tile]), (TILE_H, "I", 4, [tile]), (TILES, *wide, places), (TILE_SIZES, "I", 4, sizes), (FORMAT, "H", 3, [3])]
        if plane.grid.gt:
            g = plane.grid.gt
            tags.append((MATRIX, "d", 12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        if plane.grid.epsg:
            geographic = plane.grid.epsg in (4326,)
            tags.append((GEO_KEYS, "H", 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, plane.grid.epsg]))
        tags.append((NO_DATA, "s", 2, b"nan\0"))
        entries, inline = [], 8 if big else 4
        for tag, form, kind, values in tags:
            raw = values if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
            count = len(values)
            if len(raw) > inline:
                where = f.tell()
                f.write(raw)
                raw = struct.pack("<Q" if big else "<I", where)
            entries.append(struct.pack("<HHQ" if big else "<HHI", tag, kind, count) + raw.ljust(inline, b"\0"))
        at = f.tell()
        f.write(struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + b"\0" * (8 if big else 4))
        f.seek(8 if big else 4)
        f.write(struct.pack("<Q" if big else "<I", at))
