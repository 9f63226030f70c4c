"""Classic NetCDF (CDF-1, CDF-2, CDF-5) as a data source of cells.

`spark.read.format("netcdf3").option("variable", name).load(path)` gives one row a
cell: a long column for every dimension, and `v`, NULL for no data, with scale
and offset applied. Only headers are read on the driver; a task reads a range of
the first dimension. Options `first` and `last` bound that dimension (as do
pushed filters on it, where the session allows them).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: NetCDF's external types: NumPy's big-endian type.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
PART_CELLS = 1 << 20


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    begin: int
    #: Bytes from one record to the next, 0 if the variable has no record dimension.
    stride: int
    attrs: dict

    def cells(self) -> int:
        return math.prod(self.shape)


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]


class _Bytes:
    def __init__(self, data: bytes, version: int):
        self.data, self.at, self.wide, self.far = data, 4, version == 5, version in (2, 5)

    def take(self, form: str):
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def count(self) -> int:
        return self.take(">q" if self.wide else ">i")

    def name(self) -> str:
        n = self.count()
        out = self.data[self.at : self.at + n].decode("utf-8", "replace")
        self.at += n + -n % 4
        return out

    def attributes(self) -> dict:
        self.take(">i")
        out = {}
        for _ in range(self.count()):
            key, kind, n = self.name(), self.take(">i"), self.count()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.data[self.at : self.at + size]
            self.at += size + -size % 4
            out[key] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out


def read_header(path: str) -> Header:
    """The header of a file; it is read in growing pieces until it is whole."""
    size = 1 << 16
    while True:
        with open(path, "rb") as f:
            data = f.read(size)
        try:
            return parse_header(data)
        except (struct.error, IndexError):
            if len(data) < size:
                raise ValueError(f"{path} is cut off in its header") from None
            size *= 8


def parse_header(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file")
    b = _Bytes(data, data[3])
    records = b.count()
    b.take(">i")
    sizes = [(b.name(), b.count()) for _ in range(b.count())]
    attrs = b.attributes()
    b.take(">i")
    found = []
    for _ in range(b.count()):
        name = b.name()
        ids = [b.count() for _ in range(b.count())]
        own = b.attributes()
        kind, _, begin = b.take(">i"), b.count(), b.take(">q" if b.far else ">i")
        found.append((name, ids, own, kind, begin))
    of = lambda ids: bool(ids) and sizes[ids[0]][1] == 0
    inner = lambda ids, kind: math.prod(sizes[i][1] for i in (ids[1:] if of(ids) else ids)) * np.dtype(TYPES[kind]).itemsize
    recorded = [inner(ids, kind) for _, ids, _, kind, _ in found if of(ids)]
    # A record holds every record variable, each padded to four bytes; a lone one isn't padded.
    stride = recorded[0] if len(recorded) == 1 else sum(n + -n % 4 for n in recorded)
    variables = {}
    for name, ids, own, kind, begin in found:
        shape = tuple(records if sizes[i][1] == 0 else sizes[i][1] for i in ids)
        variables[name] = Variable(name, tuple(sizes[i][0] for i in ids), shape, TYPES[kind], begin, stride if of(ids) else 0, own)
    return Header({n: records if s == 0 else s for n, s in sizes}, attrs, variables)


def read_values(path: str, v: Variable, first: int, last: int) -> np.ndarray:
    """Stored values of first..last (excluded) along the first dimension, in C order."""
    row = math.prod(v.shape[1:]) if v.shape else 1
    size = row * np.dtype(v.dtype).itemsize
    with open(path, "rb") as f:
        if not v.stride:
            f.seek(v.begin + first * size)
            return np.frombuffer(f.read((last - first) * size), v.dtype)
        parts = []
        for k in range(first, last):
            f.seek(v.begin + k * v.stride)
            parts.append(f.read(size))
        return np.frombuffer(b"".join(parts), v.dtype)


def decoded(raw: np.ndarray, attrs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Physical values, and where there is none (fill and missing values before scale and offset, non-finite values)."""
    value = raw.astype(np.float64)
    none = ~np.isfinite(value)
    for key in ("_FillValue", "missing_value"):
        for fill in attrs.get(key, []) if isinstance(attrs.get(key), list) else []:
            none |= value == float(fill)
    scale, offset = (attrs.get(k) for k in ("scale_factor", "add_offset"))
    if isinstance(scale, list):
        value = value * scale[0]
    if isinstance(offset, list):
        value = value + offset[0]
    return value, none


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NetCDF3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def variable(self) -> Variable:
        header = read_header(self.options["path"])
        planes = [n for n, v in header.variables.items() if len(v.shape) >= 2 and v.dtype != "S1"]
        name = self.options.get("variable") or (planes[0] if planes else None)
        if name not in header.variables:
            raise ValueError(f"no variable {name!r}: {', '.join(header.variables)}")
        return header.variables[name]

    def schema(self) -> StructType:
        return StructType([*(StructField(d, LongType(), False) for d in self.variable().dims), StructField("v", DoubleType())])

    def reader(self, schema: StructType) -> NetCDF3Reader:
        first, last = (self.options.get(k) for k in ("first", "last"))
        kind = PushingReader if self.options.get("pushdown", "").lower() == "true" else NetCDF3Reader
        return kind(self.options["path"], self.variable(), None if first is None else int(first), None if last is None else int(last))


class NetCDF3Reader(DataSourceReader):
    def __init__(self, path: str, v: Variable, first: int | None, last: int | None):
        self.path, self.v = path, v
        n = v.shape[0] if v.shape else 1
        self.lo, self.hi = max(0, first or 0), min(n, n if last is None else last + 1)

    def partitions(self) -> list[InputPartition]:
        row = max(1, math.prod(self.v.shape[1:]) if self.v.shape else 1)
        step = max(1, PART_CELLS // row)
        return [Rows(k, min(k + step, self.hi)) for k in range(self.lo, self.hi, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for k in range(partition.first, partition.last):
            raw = read_values(self.path, self.v, k, k + 1)
            value, none = decoded(raw, self.v.attrs)
            inner = np.indices(self.v.shape[1:]).reshape(len(self.v.shape) - 1, -1) if self.v.shape else np.zeros((0, 1), int)
            columns = [pa.array(np.full(len(value), k, np.int64)), *(pa.array(i.astype(np.int64)) for i in inner)][: len(self.v.dims)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, mask=none)], names=[*self.v.dims, "v"])


class PushingReader(NetCDF3Reader):
    """Takes filters on the first dimension. A reader of its own, as sessions without that feature refuse it."""

    def pushFilters(self, filters: list[Filter]):
        lead = self.v.dims[0] if self.v.dims else None
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == (lead,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                k = f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = max(self.lo, k + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.hi = min(self.hi, k + (not isinstance(f, LessThan)))
            yield f  # Spark tests the rows again: the range alone is narrowed here


def small_values(path: str) -> dict[str, list[float]]:
    """The 0-D and 1-D variables: coordinates and scalars."""
    out = {}
    for n, v in read_header(path).variables.items():
        if len(v.shape) < 2 and v.dtype != "S1":
            value, none = decoded(read_values(path, v, 0, v.shape[0] if v.shape else 1), v.attrs)
            out[n] = [None if m else float(x) for x, m in zip(value, none)]
    return out


def dump(path: str) -> str:
    """The header as text in the style of ncdump -h."""
    h = read_header(path)
    show = lambda a: f'"{a}"' if isinstance(a, str) else ", ".join(map(str, a))
    lines = ["dimensions:", *(f"  {n} = {k} ;" for n, k in h.dims.items()), "variables:"]
    for v in h.variables.values():
        lines.append(f"  {np.dtype(v.dtype).name} {v.name}({', '.join(v.dims)}) ;")
        lines += [f"    {v.name}:{k} = {show(a)} ;" for k, a in v.attrs.items()]
    return "\n".join([*lines, *(f"  :{k} = {show(a)} ;" for k, a in h.attrs.items())])


def affine_of(path: str, v: Variable) -> list[float] | None:
    """The affine map from 1-D coordinate variables named like the last two dimensions; None if there is none or they aren't even."""
    values = small_values(path)
    rows, cols = values.get(v.dims[-2]), values.get(v.dims[-1])
    if not rows or not cols or len(rows) < 2 or len(cols) < 2 or None in rows or None in cols:
        return None
    dx, dy = (cols[-1] - cols[0]) / (len(cols) - 1), (rows[-1] - rows[0]) / (len(rows) - 1)
    return [cols[0] - dx / 2, dx, 0.0, rows[0] - dy / 2, 0.0, dy]


__all__ = ["NetCDF3", "Variable", "affine_of", "dump", "parse_header", "read_header", "read_values", "small_values"]
