"""The engine's queries on small tables of odd rows, held against their SQL or what it means."""

import itertools
import math
import random

import pytest
from cubara import queries
from cubara.operators import plane
from pyspark.sql import functions as F


def events(spark, path, rows):
    """Writes events (day of January 2024, hour, user, type, value) in the order of rows as one file; the folder of the tables."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, day int, hour int, user_id long, event_type string, value double")
    ts = F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.col("hour"), F.lit(0), F.lit(0))
    df.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).coalesce(1).sortWithinPartitions("event_id").write.mode("overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def test_means_in_any_order(spark, tmp_path):
    # The three add up to 50.0 in four orders and to less in two; 50 / 3 is 9.0 before it is cut to a step.
    orders = list(itertools.permutations([11.9, 20.2, 17.9]))
    rows = [(1 + k, 21, user, "view", v) for user, order in enumerate(orders) for k, v in enumerate(order)]
    at_once = [(9, 21, 10 + user, "view", v) for user, order in enumerate(orders) for v in order]
    got = queries.QUERIES["rgb"](spark, events(spark, tmp_path, rows + at_once)).collect()
    assert {(r["y"], r["g"]) for r in got} == {(u + k, 9) for u in range(6) for k in (0, 10)} and len(got) == 12


def test_steady_mean(spark):
    rng = random.Random(5)
    values = [rng.choice((1, -1)) * rng.uniform(0, 10.0 ** rng.randint(-12, 9)) for _ in range(500)]
    want = math.fsum(values) / 500
    for k in range(3):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3 + k)
        assert df.agg(plane.steady_mean(F.col("v"))).first()[0] == want
    known = lambda *v: spark.createDataFrame([(x,) for x in v], "v double").agg(plane.steady_mean(F.col("v"))).first()[0]
    assert known(None) is None and known(1e300, -1e300, 3.0) == 1.0 and known(1e-300, 3e-300) == pytest.approx(2e-300, rel=1e-15) and known(1e308) == 1e308


def sql(name, folder, table="events"):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.execute("set TimeZone = 'UTC'")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
        return con.execute(queries.ORACLES[name]).fetchall()


def same(got, want):
    """Equal rows, NaN equal to itself."""
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


#: Means of purchases and views of a user, the user's number first; None: no such event.
PAIRS = [(0, 0.0, 6.14), (1, 5.0, 0.0), (2, 0.0, 0.0), (3, -2.0, 4.0), (4, 3.0, 1.5), (5, -5.0, 0.0), (6, 1.0, None), (7, None, 1.0)]


def compared(spark, tmp_path, kind):
    rows = [(1, 12, user, name, v) for user, a, b in PAIRS for name, v in (("purchase", a), ("view", b)) if v is not None]
    folder = events(spark, tmp_path, [*rows, (2, 12, 9, "purchase", 1.0), (2, 12, 9, "view", None)])
    got = queries.QUERIES[f"compare_{kind}"](spark, folder).collect()
    assert same(got, sql(f"compare_{kind}", folder))
    return {r["y"]: r["v"] for r in got}


def test_compare_db(spark, tmp_path):
    got = compared(spark, tmp_path, "db")
    assert got.keys() == {0, 1, 2, 3, 4, 5, 9} and got[0] == -math.inf and got[1] == math.inf and got[9] is None and got[4] == pytest.approx(3.010299957)
    assert all(math.isnan(got[k]) for k in (2, 3, 5))


def test_compare_as_shown(spark):
    stack = spark.createDataFrame([(k, 0, a, b) for k, a, b in PAIRS], "y long, x long, a double, b double")
    a, b = plane.planes(stack, ["a", "b"])
    assert {r["y"]: r["v"] for r in plane.compare(a, b, "ratio").df.collect()} == {0: 0, 1: None, 2: None, 3: -0.5, 4: 2, 5: None, 6: None, 7: None}


def test_compare_percent(spark, tmp_path):
    got = compared(spark, tmp_path, "percent")
    assert got[0] == -100 and got[1] == math.inf and got[5] == -math.inf and math.isnan(got[2]) and got[3] == -150 and got[4] == 100 and got[9] is None and len(got) == 7


@pytest.mark.parametrize("kind", ["ratio", "difference"])
def test_compare_ratio(spark, tmp_path, kind):
    got = compared(spark, tmp_path, kind)
    if kind == "ratio":
        assert got[0] == 0 and got[1] == math.inf and got[5] == -math.inf and math.isnan(got[2]) and got[3] == -0.5 and got[4] == 2 and got[9] is None and len(got) == 7


def test_series_of_odd_rows(spark, tmp_path):
    # Unknown paths come last, as in the SQL; what has one time and path is in the order of page_id, however the rows lie.
    rows = [(k, None if 7 <= k < 14 else f"u{k * 37 % 101}") for k in range(-40, 40)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["step"] for r in queries.QUERIES["series_sort"](spark, str(tmp_path)).collect()}
    assert same(got.items(), sql("series_sort", tmp_path, "pages"))
    (tmp_path / "ties").mkdir()
    tied = [(k * 37 % 70, f"u{k * 37 % 70 % 2}") for k in range(70)]
    spark.createDataFrame(tied, "page_id long, url string").repartition(5).write.parquet(f"{tmp_path}/ties/pages.parquet")
    got = sorted((r["step"], r["page_id"]) for r in queries.QUERIES["series_sort"](spark, f"{tmp_path}/ties").collect())
    unknown_last = lambda p: (p % 7 == 3, p % 7)
    assert [p for _, p in got] == sorted(range(70), key=lambda p: (unknown_last(p), p % 2, p)) and [s for s, _ in got] == list(range(70))
