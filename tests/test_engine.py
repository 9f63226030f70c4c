"""The engine's own operators: known values, closed forms, round trips."""

import json
import math
import struct

import numpy as np
import pytest
from cubara.functions import colours, expression, geo, times, warp
from cubara.functions import nodata as N
from cubara.operators import catalog, plane, steps
from cubara.operators.plane import Grid, Plane
from cubara.plans import builder
from cubara.sources import codecs, geotiff, netcdf3, zarr
from cubara.streaming import steps as streaming
from pyspark.sql import functions as F


def values(spark, text, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} double" for k in inputs)) if inputs else spark.range(1)
    return row.select(expression.compile_expression(text, {k: F.col(k) for k in inputs}).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [("-2^2", -4), ("2^-1", 0.5), ("2^3^2", 512), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 < 3", 1), ("1/0", None), ("min(1/0, 5)", 5), ("5 / (1/0)", 0), ("0/0", None), ("pow(0, 0)", 1), ("clamp(7, 5, 1)", 5), ("mask(3, 1)", None), ("mask(3, 0)", 3), ("ln(0)", None), ("exp(ln(0))", 0), ("sqrt(-1)", None), ("1.5e2", 150), ("ABS(-3)", 3), ("--2", 2), ("10 - 4 - 3", 3)],
)
def test_expressions(spark, text, want):
    got = values(spark, text)
    assert got == want if want is None else got == pytest.approx(want)


def test_expressions_with_no_data(spark):
    assert values(spark, "max(a, b)", a=1.0, b=None) == 1
    assert values(spark, "a > b", a=1.0, b=float("nan")) is None
    assert values(spark, "(A - b) / (a + B)", a=3.0, b=1.0) == 0.5
    assert values(spark, "pow(a, 0)", a=None) == 1
    assert values(spark, "clamp(a, b, b)", a=3.0, b=None) == 3


@pytest.mark.parametrize("text", ["1 < 2 < 3", "a +", "f(1)", "min(1)", "q", "1 2", "(1", "$"])
def test_expression_errors(text):
    with pytest.raises(expression.ExpressionError):
        expression.parse(text, ["a"])


def test_names():
    assert expression.identifier("g/Band 3") == "b3" and expression.identifier("x/10u") == "b10u" and expression.identifier("A-b c ") == "a_b_c"
    assert [expression.letter(k) for k in (0, 25, 26)] == ["a", "z", "l27"]
    assert expression.presets(["b04", "b08"]) == ["NDVI"]


def test_times(spark):
    rows = spark.createDataFrame([("2020-01-02T03:04:05Z",), ("20200102T030405",), ("2020-1-2",), ("x",), ("2020-13-01",)], "t string")
    got = [r[0] for r in rows.select(times.parse(F.col("t"))).collect()]
    assert got == [1577934245.0, 1577934245.0, 1577923200.0, None, None]
    odd = spark.createDataFrame([("202011",), ("2020111",), ("2020-01-02T25:00",), ("2020-01-02T99:99",), ("20200102",), ("2020-01-02 10:27+02:00",), ("2020-01-02T10",), ("20200102030405",)], "t string")
    want = [None, None, None, None, 1577923200.0, 1577960820.0, 1577923200.0, None]
    assert [r[0] for r in odd.select(times.parse(F.col("t"))).collect()] == want
    assert [times.parse_text(r["t"]) for r in odd.collect()] == want
    names = spark.createDataFrame([("lst_20230714.nc",), ("S3_20210102T030405_x",), ("a-2020-05-06.tif",), ("9920200101",), ("none",)], "n string")
    got = [r[0] for r in names.select(times.text(times.in_name(F.col("n")))).collect()]
    assert got == ["2023-07-14 00:00:00", "2021-01-02 03:04:05", "2020-05-06 00:00:00", None, None]
    assert times.cf_units("hours since 2021-06-01") == (3600.0, 1622505600.0) and times.cf_units("months since 2000-01-01") is None
    assert spark.range(1).select(times.text(F.lit(-0.5))).first()[0] == "1969-12-31 23:59:59"


def test_aggregates(spark):
    rows = [(t, 0, 0, v) for t, v in enumerate([3.0, None, 1.0, 2.0, 10.0])] + [(0, 0, 1, None)]
    cube = spark.createDataFrame(rows, "time long, y long, x long, v double")
    want = {"mean": 4, "median": 2.5, "min": 1, "max": 10, "count": 4, "std": 3.5355}
    for how, v in want.items():
        got = {r["x"]: r["v"] for r in plane.aggregate(cube, "time", how).collect()}
        assert got[0] == pytest.approx(v, abs=1e-4) and got[1] == (0 if how == "count" else None)
    assert plane.aggregate(cube, "time", "max", 3, 0).where("x = 0").first()["v"] == 3
    with pytest.raises(ValueError):
        plane.aggregate(cube, "time", "mode")


def grid_of(spark, w, h, f, grid=None):
    return Plane(spark.createDataFrame([(y, x, f(y, x)) for y in range(h) for x in range(w)], "y long, x long, v double"), grid or Grid(w, h))


def test_planes(spark):
    p = grid_of(spark, 10, 6, lambda y, x: None if (y, x) == (0, 0) else float(10 * y + x))
    c = {(r["y"], r["x"]): r["v"] for r in p.coarsen(4).df.collect()}
    assert c[0, 0] == pytest.approx(sum(10 * y + x for y in range(4) for x in range(4) if y + x) / 15) and c[1, 2] == pytest.approx(53.5) and len(c) == 6
    assert p.window(2, 1, 3, 2).df.count() == 6 and p.probe(3, 2).first()["v"] == 23
    with pytest.raises(plane.GridError):
        p.window(8, 0, 3, 1)
    with pytest.raises(plane.GridError):
        plane.layer_math("a + b", {"a": p, "b": p.coarsen(2)})
    m = plane.layer_math("mask(a - b / 2, a <= 20)", {"a": p, "b": p})
    assert m.df.where("v is not null").count() == 39 and m.probe(1, 2).first()["v"] == 10.5
    s = Plane(spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, None, 3.0, 4.0])], "y long, x long, v double")).statistics().first()
    assert (s["n"], s["mean"], s["std"]) == (4, 2.5, pytest.approx(math.sqrt(1.25)))
    assert p.to_numpy()[5, 9] == 59 and np.isnan(p.to_numpy()[0, 0])
    assert plane.axes_proposal(["time", "dim_lat", "dim_lon", "k"]) == ("dim_lat", "dim_lon") and plane.axes_proposal(["a", "b", "c"]) == ("b", "c")


def test_polygon(spark):
    p = grid_of(spark, 4, 4, lambda y, x: float(4 * y + x))
    # A triangle around a 4 x 4 window keeps six cells.
    kept = p.masked([(0, 0), (4, 0), (0, 4)]).df.where("v is not null")
    assert sorted(int(r["v"]) for r in kept.collect()) == [0, 1, 2, 4, 5, 8]
    pts = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (0, 4)]))
    assert p.df.where(geo.inside_points(pts, F.col("x") + 0.5, F.col("y") + 0.5)).count() == 6


def test_distributions(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert plane.quantile(df, 0.98).first()["q"] == 9 and plane.quantile(df, 0).first()["q"] == 1
    h = {r["bin"]: r["n"] for r in plane.histogram(df, 0, 10, 5).collect()}
    assert h == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2}
    pairs = df.select(F.col("v").alias("a"), F.col("v").alias("b"))
    s = plane.scatter_statistics(pairs).first()
    assert s["r"] == pytest.approx(1) and s["bias"] == 0 and s["rmsd"] == 0


def slow_utm(lon, lat, middle):
    """The classic series in powers of the longitude's difference, another one than the engine's."""
    a, e2 = 6378137.0, 0.0066943799901413165
    p, ep2 = math.radians(lat), e2 / (1 - e2)
    n, t, c, d = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep2 * math.cos(p) ** 2, math.radians(lon - middle) * math.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    x = n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * d**5 / 120)
    y = m + n * math.tan(p) * (d**2 / 2 + (5 - t + 9 * c + 4 * c**2) * d**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * d**6 / 720)
    return 0.9996 * x + 500000, 0.9996 * y


def test_geo(spark):
    row = spark.range(1)
    at = lambda *c: row.select(*c).first()
    x, y = at(*geo.project(F.lit(11.5), F.lit(48.1), 32632))
    assert (x, y) == (pytest.approx(slow_utm(11.5, 48.1, 9.0)[0], abs=0.01), pytest.approx(slow_utm(11.5, 48.1, 9.0)[1], abs=0.01))
    for epsg, lon, lat in ((32632, 11.5, 48.1), (32733, 15.5, -33.2), (3857, -70.2, 40.5), (3413, 100.0, 75.0), (3031, -120.0, -80.0), (4326, 5.0, 6.0)):
        x, y = at(*geo.project(F.lit(lon), F.lit(lat), epsg))
        back = at(*geo.unproject(F.lit(x), F.lit(y), epsg))
        assert tuple(back) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9)), epsg
    # The equator on a zone's central meridian, and the polar system's own centre line.
    assert tuple(at(*geo.utm(F.lit(9.0), F.lit(0.0), 32))) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    lon, lat = at(*geo.ecef_to_geodetic(F.lit(6378137.0), F.lit(0.0), F.lit(0.0)))
    assert (lon, lat) == (0, pytest.approx(0))
    assert at(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0] == pytest.approx(math.pi / 2 * 6371008.8)
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    assert at(geo.sphere_area(pts((0, 0), (1, 0), (1, 1), (0, 1))))[0] == pytest.approx(1.2364e10, rel=1e-3)
    assert at(geo.sphere_area(pts((179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1))))[0] == pytest.approx(1.2364e10, rel=1e-3)
    assert at(geo.bilinear(F.lit(0.5), F.lit(0.5), F.lit(179.0), F.lit(-179.0), F.lit(179.0), F.lit(-179.0), True))[0] == pytest.approx(-180)
    assert at(geo.packed_degrees(F.lit(-12030030.0)))[0] == pytest.approx(-12.508333, abs=1e-6)
    assert at(geo.default_epsg(F.lit(11.5), F.lit(48.0)), geo.default_epsg(F.lit(0.0), F.lit(-85.0))) == (32632, 3031)


def test_nearest(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 15.0), (3, None), (4, 99.0), (5, -5.0)], "id long, t double")
    right = spark.createDataFrame([(10.0, "a"), (20.0, "b"), (40.0, "c")], "t double, name string")
    names = lambda **k: {r["id"]: r["name"] for r in steps.nearest(left, right, **k).collect()}
    assert names() == {1: "a", 2: "a", 3: None, 4: "c", 5: "a"}
    assert names(later=True)[2] == "b" and names(tolerance=6)[4] is None
    assert {r["id"]: r["name"] for r in steps.nearest(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), by=["g"]).collect()} == names()


def test_steps(spark):
    cube = spark.createDataFrame([(0, 0, s, float(v)) for s, v in ((0, 0), (1, 4), (2, 8))], "y long, x long, step long, v double")
    got = sorted((r["frame"], r["v"]) for r in steps.interpolate(cube, "step", 4).collect())
    assert got == [(k, float(k)) for k in range(9)]


def test_catalog(spark):
    items = spark.createDataFrame([("a", "T1", 20.0, 0), ("b", "T1", None, 1), ("c", "T2", 5.0, 2), ("d", "T2", 5.0, 3)], "id string, tile string, cloud double, seq long")
    assert {r["id"] for r in catalog.best_per_tile(items).collect()} == {"b", "c"}
    assert {r["id"] for r in catalog.under_cloud(items, 10).collect()} == {"b", "c", "d"}
    row = spark.range(1)
    assert row.select(catalog.clean_path(F.lit("https://me:pw@h/a/b.nc?x=1#y"))).first()[0] == "https://h/a/b.nc"
    assert row.select(catalog.identifier(F.lit("g/Band 12")), catalog.fuzzy(F.lit("Sea surface"), "ssf"), catalog.fuzzy(F.lit("Sea"), "x")).first() == ("b12", 5, None)
    assert catalog.log_ticks(1, 100) == [1, 2, 5, 10, 20, 50, 100] and catalog.round_length(73) == 50


def cdf(version, records):
    """A file with grid(lat 2, lon 3), temp(time, lat, lon) packed, by hand."""
    wide = ">q" if version == 5 else ">i"
    n = lambda k: struct.pack(wide, k)
    name = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    off = lambda k: struct.pack(">i" if version == 1 else ">q", k)
    att = lambda k, kind, form, v: name(k) + struct.pack(">i", kind) + n(1) + (raw := struct.pack(form, v)) + b"\0" * (-len(raw) % 4)

    def header(at):
        h = b"CDF" + bytes([version]) + n(records) + struct.pack(">i", 10) + n(3) + name("time") + n(0) + name("lat") + n(2) + name("lon") + n(3) + struct.pack(">i", 0) + n(0)
        h += struct.pack(">i", 11) + n(3)
        h += name("grid") + n(2) + n(1) + n(2) + struct.pack(">i", 0) + n(0) + struct.pack(">i", 5) + n(24) + off(at)
        h += name("temp") + n(3) + n(0) + n(1) + n(2) + struct.pack(">i", 12) + n(3) + att("scale_factor", 5, ">f", 0.5) + att("add_offset", 5, ">f", 100) + att("_FillValue", 3, ">h", -1) + struct.pack(">i", 3) + n(12) + off(at + 24)
        h += name("tick") + n(1) + n(0) + struct.pack(">i", 0) + n(0) + struct.pack(">i", 1) + n(4) + off(at + 36)
        return h

    size = len(header(0))
    body = struct.pack(">6f", *range(6))
    for r in range(records):
        body += struct.pack(">6h", *((r * 6 + k) if r * 6 + k != 7 else -1 for k in range(6))) + bytes([r, 0, 0, 0])
    return header(size) + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf3(spark, tmp_path, version):
    path = str(tmp_path / "a.nc")
    with open(path, "wb") as f:
        f.write(cdf(version, 3))
    spark.dataSource.register(netcdf3.NetCDF3)
    got = {(r["time"], r["lat"], r["lon"]): r["v"] for r in spark.read.format("netcdf3").option("variable", "temp").load(path).collect()}
    assert got == {(t, y, x): None if t * 6 + y * 3 + x == 7 else (t * 6 + y * 3 + x) * 0.5 + 100 for t in range(3) for y in range(2) for x in range(3)}
    assert spark.read.format("netcdf3").option("variable", "temp").option("first", 1).option("last", 1).load(path).count() == 6
    assert spark.read.format("netcdf3").load(path).agg(F.sum("v")).first()[0] == 15
    assert "temp(time, lat, lon)" in netcdf3.dump(path) and netcdf3.small_values(path)["tick"] == [0, 1, 2]


def test_zarr(spark, tmp_path):
    a = np.arange(35, dtype="<i2").reshape(5, 7)
    zarr.write(str(tmp_path / "z/b1"), a, (2, 3), {"_ARRAY_DIMENSIONS": ["y", "x"], "scale_factor": 0.1}, fill=11)
    (tmp_path / "z/b1/0.0").unlink()
    spark.dataSource.register(zarr.Zarr)
    got = {(r["y"], r["x"]): r["v"] for r in spark.read.format("zarr").option("array", "b1").load(str(tmp_path / "z")).collect()}
    want = {(y, x): None if (y < 2 and x < 3) or a[y, x] == 11 else pytest.approx(a[y, x] * 0.1) for y in range(5) for x in range(7)}
    assert got == want and zarr.arrays(str(tmp_path / "z")) == ["b1"]


def test_geotiff(spark, tmp_path):
    grid = Grid(70, 50, (5.0, 0.5, 0.0, 60.0, 0.0, -0.25), 4326)
    p = grid_of(spark, 70, 50, lambda y, x: None if y == 3 else y * 100.0 + x, grid)
    path = str(tmp_path / "a.tif")
    geotiff.write_plane(p, path, tile=32)
    im = geotiff.levels(path)[0]
    assert im.gt == list(grid.gt) and im.epsg == 4326 and im.chunk == (32, 32)
    spark.dataSource.register(geotiff.GeoTiff)
    got = spark.read.format("geotiff").load(path)
    assert {(r["y"], r["x"]): r["v"] for r in got.collect()} == {(r["y"], r["x"]): r["v"] for r in p.df.collect()}


def test_codecs():
    import zstandard

    assert codecs.packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    assert codecs.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert codecs.lz4_block(bytes([0x1F, 65, 1, 0, 5, 0x10, 66])) == b"A" * 25 + b"B"
    a = np.arange(9, dtype="<u4")
    assert codecs.unshuffle(a.view(np.uint8).reshape(9, 4).T.tobytes(), 4) == a.tobytes()
    assert codecs.undelta(np.diff(a, prepend=a.dtype.type(0)).tobytes(), "<u4") == a.tobytes()
    assert codecs.decode(zstandard.compress(b"x" * 99), [("zstd", {})]) == b"x" * 99
    d = np.diff(np.array([[5, 7, 11]], "<i2"), prepend=np.int16(0)).astype("<i2").tobytes()
    assert np.frombuffer(codecs.predictor(d, 2, 3, 1, "<i2"), "<i2").tolist() == [5, 7, 11]


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(0, 0, float(k)), (0, 1, None)], "y long, x long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    q = streaming.running(streaming.step_stream(spark, str(tmp_path / "steps"), "y long, x long, v double"), "mean").writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["x"], r["v"]) for r in spark.table("means").collect()} == {(0, 1.0), (1, None)}
    polls = [("p", s, k) for k, s in enumerate("aabbbcdde")] + [("q", "a", 0), ("q", "b", 1)]
    table = spark.createDataFrame(polls, "path string, stamp string, poll long")
    assert sorted(map(tuple, streaming.changed_batch(table).collect())) == [("p", "b"), ("p", "d")]
    table.coalesce(1).write.parquet(str(tmp_path / "polls"))
    q = streaming.changed_products(spark.readStream.schema(table.schema).parquet(str(tmp_path / "polls"))).writeStream.format("memory").queryName("changed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("changed").collect())) == [("p", "b"), ("p", "d")]


def test_plans(spark, tmp_path):
    cube = spark.createDataFrame([(t, y, x, float(t + y * 10 + x)) for t in range(3) for y in range(4) for x in range(4)], "time long, y long, x long, v double")
    mean = {"kind": "aggregate", "source": "c", "along": "time", "how": "mean", "first": 2, "last": 0}
    plan = {"kind": "coarsen", "factor": 2, "input": {"kind": "math", "text": "a - b", "inputs": {"a": mean, "b": {"kind": "layer", "source": "c", "at": {"time": 0}}}}}
    import json

    assert [r["v"] for r in builder.build(json.dumps(plan), {"c": cube}).df.collect()] == [1.0] * 4
    p = Plane(plane.aggregate(cube, "time", "mean"), Grid(4, 4))
    builder.export_csv(p, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    with pytest.raises(ValueError):
        builder.build({"kind": "x"}, {})


def test_decode(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (float("nan"),), (float("inf"),), (None,)], "r double")
    assert [r[0] for r in df.select(N.decode(F.col("r"), 0, 2, 1)).collect()] == [11.0, None, None, None, None]
    assert spark.range(1).select(N.complex_part(F.lit(3), F.lit(4), "Amp"), N.db(F.lit(-10.0))).first() == (5.0, 20.0)


def test_texts_and_lists(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [tuple(p) for p in one(catalog.attribute_pairs(F.lit('{"a":1,"b":"x","c":{"d":[2]}}')))] == [("a", "1"), ("b", "x"), ("c", '{"d":[2]}')]
    assert [one(catalog.number_text(F.lit(v))) for v in (1.5, 100.0, 0.0, 1234567.0, -0.00012, 0.12345)] == ["1.5", "100", "0", "1.235e6", "-1.200e-4", "0.1235"]
    assert [one(catalog.length_text(F.lit(v))) for v in (9999.96, 12345.0, 3.14)] == ["10000 m", "12.35 km", "3.1 m"]
    assert [one(catalog.area_text(F.lit(v))) for v in (999999.4, 1234567.0)] == ["999999 m²", "1.23 km²"]
    assert catalog.ticks(0, 10, 5) == ([0, 2, 4, 6, 8, 10], 2) and catalog.ticks(3, 3) == ([3], 1.0) and catalog.ticks(10, 0, 4)[1] == 2.5
    assert catalog.tick_text(2.5, 2.5) == "2.5" and catalog.tick_text(-0.0, 1) == "0" and catalog.rounded_text(1.23456, 0.01) == "1.23"
    xml = "<a xmlns='u' xmlns:s='v'><s:b k='1'> x </s:b><b k='2'>y</b></a>"
    assert one(catalog.xml_texts(F.lit(xml), "/a/b")) == ["x", "y"] and one(catalog.xml_texts(F.lit(xml), "/a/b/@k")) == ["1", "2"]
    lines = spark.createDataFrame([("a.nc",), ("# c",), ("",), (" /x/b.nc",), ("s3://k/c",)], "value string")
    assert [r[0] for r in catalog.product_list(lines, "/d/").collect()] == ["/d/a.nc", "/x/b.nc", "s3://k/c"]
    assert catalog.address("f.nc#wind") == ("f.nc", "wind", "") and catalog.address("f#=a+b") == ("f", "expression", "a+b") and catalog.address("f#sst") == ("f", "variable", "sst") and catalog.address("f") == ("f", "", "")
    assert [r["url"] for r in catalog.dated_urls(spark, "2020-02-28", "2020-03-01", "'u/'yyyyMMdd").collect()] == ["u/20200228", "u/20200229", "u/20200301"]
    assert list(catalog.pages_of({"a": ([1, 2], "b"), "b": ([3], "a")}.get, "a")) == [1, 2, 3]
    assert catalog.asked([("t", 5), ("z", 2), ("y", 9), ("x", 9)], ("y", "x"), "t") and not catalog.asked([("t", 5), ("y", 9), ("x", 9)], ("y", "x"), "t")
    assert catalog.step_index(3, 5, 6) == 5 and catalog.axis_values(2, None, [1]) == [0, 1] and catalog.axis_values(2, start=10, step=2) == [11, 13]
    assert catalog.index_text(1, "level", [850.0, 500.0], "hPa") == "level 1 (500 hPa)"
    assert [tuple(p) for p in one(catalog.points_of(F.lit("1, 2\nx\n3;4.5\n-1e2 7")))] == [(1, 2), (3, 4.5), (-100, 7)]
    assert one(times.between_steps(F.lit(10.0), F.lit(20.0), F.lit(0.25))) == 12.5


def test_planes_of_one_frame(spark):
    stack = spark.createDataFrame([(0, 0, 1.0, 3.0, True, True), (0, 1, 2.0, None, True, False), (1, 0, None, 5.0, False, True)], "y int, x int, a double, b double, has_a boolean, has_b boolean")
    a, b = plane.planes(stack, ["a", "b"])
    assert sorted(map(tuple, plane.layer_math("a + b", {"a": a, "b": b}).df.collect())) == [(0, 0, 4.0)]
    for pair in ((a, b), (Plane(a.df), Plane(b.df))):
        assert sorted(map(tuple, plane.stack_over([(pair[0], 1.0), (pair[1], 0.5)]).collect())) == [(0, 0, 2.0), (0, 1, 2.0), (1, 0, 5.0)]
        assert sorted(map(tuple, plane.rgb(*pair, pair[0], [(0, 5)] * 3).select("y", "x", "g").collect())) == [(0, 0, 153), (0, 1, 0), (1, 0, 255)]
        assert len(plane.swipe(*pair, 1).collect()) == 3
    assert "Join" not in plane.compare(a, b, "ratio").df._jdf.queryExecution().toString()
    with pytest.raises(plane.GridError):
        plane.swipe(Plane(a.df, Grid(2, 2)), Plane(b.df, Grid(3, 2)), 1)
    assert plane.mask_where(a, b.df).df.count() == 1 and plane.mask_where(a, b.df, False).df.count() == 1
    window = a.window(0, 0, 1, 1)
    assert plane.layer_math("a", {"a": window}).df.count() == 1
    assert [r["v"] for r in plane.box_mean(spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 5.0), (5, 5, None)], "y int, x int, v double"), 1).orderBy("y", "x").collect()] == [1, 3, 3, 5, None]
    table = plane.values_window(Plane(a.df, Grid(2, 2)), 5, 5, 2, 2)
    assert [r["values"] for r in table.orderBy("y").collect()] == [[1.0, 2.0], [None, None]]
    assert plane.value_sample(spark.range(100).selectExpr("id div 10 as y", "id % 10 as x", "1d as v"), 10, 10, 20).count() == 20
    with pytest.raises(ValueError):
        plane.check_size(10**9, 8, 1 << 30)
    line = plane.polyline(Plane(spark.range(25).selectExpr("id div 5 as y", "id % 5 as x", "cast(id as double) as v")), [(0.5, 0.5), (4.5, 0.5), (4.5, 2.5)])
    assert [r["v"] for r in line.orderBy("k").collect()] == [0, 1, 2, 3, 4, 9, 14]
    assert plane.level_for([1, 2, 4, 8], 5) == 2 and plane.level_for([4, 8], 1) == 0
    assert plane.tile_range(5, 5, 20, 9, 8, 100, 8) == (0, 2, 0, 0) and plane.tile_range(-9, 0, -1, 5, 8, 10, 10)[:2] == (0, -1)
    assert plane.pixel_box(Grid(10, 10, (100, 1, 0, 50, 0, -1)), (102.5, 45, 104, 47.5)) == (2, 2, 4, 5) and plane.pixel_box(Grid(10, 10, (100, 1, 0, 50, 0, -1)), (0, 0, 5, 5)) is None
    assert plane.type_range("<i2", -0.5, 1) == (-16382.5, 16385.0) and plane.type_range("f4") is None
    assert plane.aggregate_units("count", "K") == "" and plane.aggregate_units("mean", "K") == "K"
    many = spark.range(5000).selectExpr("cast(id * 7919 % 311 as double) as v")
    known = sorted(r["v"] for r in many.collect())
    for p in (0.0, 0.02, 0.5, 0.98, 1.0):
        assert plane.quantile(many, p).first()["q"] == known[math.floor(4999 * p)]
    assert plane.quantile(many.where("v < 0"), 0.5).count() == 0


def test_warps(spark):
    f = lambda c, r: (170 + 0.2 * c + 0.001 * c * r, 10 + 0.1 * r + 0.0005 * c * c)
    grid = warp.Nodes.of_function(lambda c, r: ((f(c, r)[0] + 180) % 360 - 180, f(c, r)[1]), 100, 80, True)
    c, r = np.array([0.0, 12.5, 99.0, 50.0]), np.array([0.0, 40.0, 79.0, 3.25])
    assert grid.repeats() and np.allclose(grid.at(c, r), f(c, r), atol=0.05 * grid.pixel_size())
    x, y = grid.at(c, r)
    assert np.allclose(grid.inverse(x, y), (c, r), atol=1e-3) and np.isnan(grid.inverse([0.0], [80.0])[0][0])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(0.0, 80.0), (None, 1.0)], "x double, y double")
    got = sorted(((round(q["col"], 3), round(q["row"], 3)) if q["col"] is not None else None for q in warp.located(rows, grid).collect()), key=str)
    assert got == sorted([(0.0, 0.0), (12.5, 40.0), (99.0, 79.0), (50.0, 3.25), None, None], key=str)
    back = warp.placed(spark.createDataFrame([(12.5, 40.0)], "col double, row double"), grid).first()
    assert np.allclose((back["px"], back["py"]), (x[1], y[1]))
    cc, rr = np.meshgrid(np.arange(600.0), np.arange(300.0))
    swath = warp.Nodes.of_arrays(5 + 0.015 * cc - 0.003 * rr, 45 + 0.01 * rr + 0.002 * cc)
    assert swath.x.shape[1] <= 257 and np.allclose(swath.at(333.0, 222.0), (5 + 0.015 * 333 - 0.003 * 222, 45 + 2.22 + 0.666))
    line = warp.unwrapped(spark.createDataFrame([(0, 179.0), (1, -179.0), (2, -178.0), (3, 179.5)], "k int, lon double"), "lon", "k")
    assert [q["lon"] for q in line.orderBy("k").collect()] == [179, 181, 182, 179.5]
    assert spark.range(1).select(warp.centre_values(F.array(*map(F.lit, [0.0, 1.0, 2.0, 3.0, 4.0])), 2)).first()[0] == [0.5, 2.5, 4.0]
    assert warp.corners("G", "453000N0101530W" * 4)[0] == (-(10 + 15 / 60 + 30 / 3600), 45.5) and warp.corners("D", "+45.500+010.250" * 4)[3] == (10.25, 45.5) and warp.corners("U", "x" * 60) is None
    square = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))))
    assert spark.range(1).select(geo.polygon_area(square, False, 10.0)).first()[0] == 400


def test_colours_and_exports(spark, tmp_path):
    table = colours.read_map("# c\n0 0 0 0\n50, 255 0 0\n200 255 255 255")
    assert [p for p, _ in table] == [0, 0.25, 1]
    got = spark.createDataFrame([(0.125,), (2.0,), (None,)], "v double").select(colours.colour(F.col("v"), table)).collect()
    assert [g[0] and tuple(g[0]) for g in got] == [(128, 0, 0), (255, 255, 255), None]
    assert colours.read_map("0 0 0\n1 1 1") == [(0.0, (0, 0, 0)), (1.0, (1, 1, 1))]
    plan = {"kind": "math", "text": "a", "inputs": {"a": {"kind": "layer", "source": "s"}}}
    assert json.loads(builder.save(plan)) == plan
    with pytest.raises(ValueError):
        builder.save({"kind": "math", "text": "a", "inputs": {"a": {"kind": "layer"}}})
    pairs = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    builder.export_pairs(pairs, str(tmp_path / "p"))
    builder.export_series(pairs, str(tmp_path / "s"), "b", {"a": "first"})
    builder.export_values(spark.createDataFrame([(3, [1.0, None])], "y int, values array<double>"), str(tmp_path / "v"), 7)
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / n))
    assert read("p").columns == ["x", "y"] and read("p").count() == 1 and read("s").columns == ["b", "first"] and [tuple(r) for r in read("v").collect()] == [("3", "1.0", None)] and read("v").columns == ["y", "7", "8"]


def test_blosc_bits_and_limits(monkeypatch):
    values = np.arange(64, dtype="<u4") * 977
    bits = np.unpackbits(values.view(np.uint8).reshape(64, 4), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").tobytes()
    head = struct.pack("<BBBBIII", 2, 1, 4 | 16 | (4 << 5), 4, 256, 256, 0)
    assert codecs.blosc(head + struct.pack("<i", 20) + struct.pack("<i", 256) + planes) == values.tobytes()
    # 64 elements in a block are too few to be split by byte.
    head = struct.pack("<BBBBIII", 2, 1, 1 | (4 << 5), 4, 256, 256, 0)
    shuffled = values.view(np.uint8).reshape(64, 4).T.tobytes()
    assert codecs.blosc(head + struct.pack("<i", 20) + struct.pack("<i", 256) + shuffled) == values.tobytes()
    monkeypatch.setattr(codecs, "LIMIT", 1000)
    import gzip
    import zlib

    import zstandard

    for name, data in (("zlib", zlib.compress(bytes(2000))), ("gzip", gzip.compress(bytes(2000))), ("zstd", zstandard.compress(bytes(2000)))):
        with pytest.raises(ValueError):
            codecs.decode(data, [(name, {})])
