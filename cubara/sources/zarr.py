"""Zarr arrays (version 2 and 3) as a data source of cells.

`spark.read.format("zarr").option("array", "group/name").load(store)` gives one row
a cell: d0, d1 ... or the array's dimension names, and `v` (NULL for the fill
value, scale and offset applied). A task reads a run of chunks, so millions of
chunks don't make millions of partitions; a missing chunk is all fill.
"""

from __future__ import annotations

import itertools
import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cubara.sources import codecs

PART_CELLS = 1 << 21
_V3_TYPES = {"bool": "u1", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float32": "f4", "float64": "f8"}


@dataclass(frozen=True)
class Array:
    path: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    fill: float | None
    steps: list = field(hash=False)
    dims: tuple[str, ...] = ()
    attrs: dict = field(default_factory=dict, hash=False)
    separator: str = "."
    prefix: str = ""
    order: str = "C"

    def key(self, index: tuple[int, ...]) -> str:
        name = self.separator.join(map(str, index)) if index else ("0" if not self.prefix else "")
        return f"{self.path}/{self.prefix}{name}"


def _number(fill) -> float | None:
    return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(fill) if isinstance(fill, str) else None if fill is None else float(fill)


def describe(path: str) -> Array:
    """An array's metadata."""
    if os.path.exists(f"{path}/zarr.json"):
        with open(f"{path}/zarr.json") as f:
            m = json.load(f)
        if m.get("node_type") != "array":
            raise ValueError(f"{path} is a group")
        steps, order = [], "<"
        for c in reversed(m["codecs"]):
            conf = c.get("configuration", {})
            if c["name"] == "bytes":
                order = ">" if conf.get("endian") == "big" else "<"
            elif c["name"] in ("sharding_indexed", "transpose"):
                raise ValueError(f"codec {c['name']!r} isn't supported")
            else:
                steps.append((c["name"], conf))
        encoding = m.get("chunk_key_encoding", {"name": "default"})
        default = encoding["name"] == "default"
        separator = encoding.get("configuration", {}).get("separator", "/" if default else ".")
        return Array(path, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), order + _V3_TYPES[m["data_type"]], _number(m.get("fill_value")), steps, tuple(m.get("dimension_names") or ()), m.get("attributes", {}), separator, f"c{separator}" if default else "")
    with open(f"{path}/.zarray") as f:
        m = json.load(f)
    attrs = {}
    if os.path.exists(f"{path}/.zattrs"):
        with open(f"{path}/.zattrs") as f:
            attrs = json.load(f)
    steps = [(m["compressor"]["id"], m["compressor"])] if m.get("compressor") else []
    steps += [(c["id"], c) for c in reversed(m.get("filters") or [])]
    return Array(path, tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], _number(m.get("fill_value")), steps, tuple(attrs.get("_ARRAY_DIMENSIONS", ())), attrs, m.get("dimension_separator", "."), "", m.get("order", "C"))


def arrays(store: str) -> list[str]:
    """Names of a store's arrays."""
    out = []
    for folder, _, files in os.walk(store):
        if ".zarray" in files or "zarr.json" in files and json.load(open(f"{folder}/zarr.json")).get("node_type") == "array":
            out.append(os.path.relpath(folder, store))
    return sorted(out)


def read_chunk(a: Array, index: tuple[int, ...]) -> np.ndarray | None:
    """Stored values of a chunk in its full shape; None if it is absent."""
    path = a.key(index)
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        data = codecs.decode(f.read(), a.steps)
    return np.frombuffer(data, a.dtype).reshape(a.chunk, order=a.order)


@dataclass
class Chunks(InputPartition):
    first: int
    last: int


class Zarr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def array(self) -> Array:
        path = self.options["path"].rstrip("/")
        return describe(f"{path}/{self.options['array']}" if self.options.get("array") else path)

    def schema(self) -> StructType:
        a = self.array()
        return StructType([*(StructField(d, LongType(), False) for d in dims_of(a)), StructField("v", DoubleType())])

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(self.array())


def dims_of(a: Array) -> list[str]:
    return list(a.dims) if len(a.dims) == len(a.shape) else [f"d{k}" for k in range(len(a.shape))]


class ZarrReader(DataSourceReader):
    def __init__(self, a: Array):
        self.a = a
        self.grid = [-(-n // c) for n, c in zip(a.shape, a.chunk)]

    def partitions(self) -> list[InputPartition]:
        total, step = math.prod(self.grid), max(1, PART_CELLS // max(1, math.prod(self.a.chunk)))
        return [Chunks(k, min(k + step, total)) for k in range(0, total, step)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        a = self.a
        scale, offset = float(a.attrs.get("scale_factor", 1)), float(a.attrs.get("add_offset", 0))
        for k in range(partition.first, partition.last):
            index = tuple(int(i) for i in np.unravel_index(k, self.grid)) if self.grid else ()
            low = [i * c for i, c in zip(index, a.chunk)]
            size = [min(c, n - o) for o, c, n in zip(low, a.chunk, a.shape)]
            stored = read_chunk(a, index)
            if stored is None:
                value, none = np.zeros(math.prod(size)), np.ones(math.prod(size), bool)
            else:
                value = stored[tuple(slice(0, n) for n in size)].astype(np.float64).ravel()
                none = ~np.isfinite(value)
                if a.fill is not None and not math.isnan(a.fill):
                    none |= value == a.fill
            at = np.indices(size).reshape(len(size), -1)
            columns = [pa.array((i + o).astype(np.int64)) for i, o in zip(at, low)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value * scale + offset, mask=none)], names=[*dims_of(a), "v"])


def find_key(value, key: str):
    """The first value of a key anywhere in nested JSON."""
    if isinstance(value, dict):
        if key in value:
            return value[key]
        value = value.values()
    elif not isinstance(value, list):
        return None
    return next((x for x in (find_key(v, key) for v in value) if x is not None), None)


def write(path: str, values: np.ndarray, chunk: tuple[int, ...], attrs: dict | None = None, fill: float | None = None) -> None:
    """A small array as a version 2 store with zlib chunks, for tests and fixtures."""
    import zlib

    os.makedirs(path, exist_ok=True)
    meta = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunk), "dtype": values.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}
    with open(f"{path}/.zarray", "w") as f:
        json.dump(meta, f)
    with open(f"{path}/.zattrs", "w") as f:
        json.dump(attrs or {}, f)
    for index in itertools.product(*(range(-(-n // c)) for n, c in zip(values.shape, chunk))):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunk))]
        whole = np.full(chunk, 0 if fill is None else fill, values.dtype)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        with open(f"{path}/{'.'.join(map(str, index))}", "wb") as f:
            f.write(zlib.compress(whole.tobytes()))
