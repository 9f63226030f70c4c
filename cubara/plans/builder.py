"""Computed layers as JSON: a plan is kept as data and built into a DataFrame again.

  {"kind": "layer", "source": NAME, "at": {DIM: INDEX}, "y": DIM, "x": DIM}
  {"kind": "aggregate", "source": NAME, "along": DIM, "how": HOW, "first": N, "last": N}
  {"kind": "math", "text": EXPRESSION, "inputs": {LETTER: PLAN}}
  {"kind": "coarsen", "input": PLAN, "factor": F}
  {"kind": "mask", "input": PLAN, "points": [[X, Y], ...]}
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from cubara.operators import plane
from cubara.operators.plane import Grid, Plane


def build(plan: str | Mapping, cubes: Mapping[str, DataFrame], grids: Mapping[str, Grid] | None = None) -> Plane:
    """The plane of a plan over named cubes; equal inputs are built once, so they are one DataFrame."""
    made: dict[str, Plane] = {}
    grids = grids or {}

    def layer(p: Mapping) -> Plane:
        return plane.pick(_cube(p), p.get("y", "y"), p.get("x", "x"), p.get("at"), grid=grids.get(p["source"]), name=p["source"])

    def aggregate(p: Mapping) -> Plane:
        df = plane.aggregate(_cube(p), p["along"], p["how"], p.get("first"), p.get("last"))
        return Plane(df.select("y", "x", "v"), grids.get(p["source"], Grid()), name=f"{p['how']} of {p['source']}")

    def math(p: Mapping) -> Plane:
        return plane.layer_math(p["text"], {k: of(v) for k, v in p["inputs"].items()}, p.get("strict", False))

    def coarsen(p: Mapping) -> Plane:
        return of(p["input"]).coarsen(p["factor"])

    def mask(p: Mapping) -> Plane:
        return of(p["input"]).masked([tuple(q) for q in p["points"]])

    kinds: dict[str, Callable[[Mapping], Plane]] = {"layer": layer, "aggregate": aggregate, "math": math, "coarsen": coarsen, "mask": mask}

    def _cube(p: Mapping) -> DataFrame:
        if p["source"] not in cubes:
            raise ValueError(f"no cube {p['source']!r}: {', '.join(cubes)}")
        return cubes[p["source"]]

    def of(p: Mapping) -> Plane:
        if p.get("kind") not in kinds:
            raise ValueError(f"no kind of plan {p.get('kind')!r}: {', '.join(kinds)}")
        key = json.dumps(p, sort_keys=True)
        if key not in made:
            made[key] = kinds[p["kind"]](p)
        return made[key]

    return of(json.loads(plan) if isinstance(plan, str) else plan)


def save(plan: Mapping) -> str:
    """A plan as JSON text that build() takes again; its kinds and fields are checked first."""
    fields = {"layer": {"source"}, "aggregate": {"source", "along", "how"}, "math": {"text", "inputs"}, "coarsen": {"input", "factor"}, "mask": {"input", "points"}}

    def check(p: Mapping) -> None:
        if p.get("kind") not in fields:
            raise ValueError(f"no kind of plan {p.get('kind')!r}: {', '.join(fields)}")
        if lacking := fields[p["kind"]] - p.keys():
            raise ValueError(f"{p['kind']} lacks {', '.join(sorted(lacking))}")
        for inner in [*p.get("inputs", {}).values(), *([p["input"]] if "input" in p else [])]:
            check(inner)

    check(plan)
    return json.dumps(plan, sort_keys=True, ensure_ascii=False)


def export_series(df: DataFrame, path: str, along: str, names: Mapping[str, str] | None = None) -> None:
    """Lines of a chart as CSV, a row a place along the axis in order, blank for no data; names: columns and their titles."""
    _csv(df.select(along, *(df[c].alias(t) for c, t in (names or {c: c for c in df.columns if c != along}).items())).orderBy(along), path)


def export_pairs(df: DataFrame, path: str, x: str = "a", y: str = "b", titles: tuple[str, str] = ("x", "y")) -> None:
    """The pairs of a scatter that are known on both sides as CSV."""
    _csv(df.where(df[x].isNotNull() & df[y].isNotNull()).select(df[x].alias(titles[0]), df[y].alias(titles[1])), path)


def export_values(window: DataFrame, path: str, column: int = 0) -> None:
    """A table of values (y, values) as CSV with the row first and the column numbers as the head."""
    n = len(window.first()["values"])
    _csv(window.orderBy("y").select("y", *(window["values"][k].alias(str(column + k)) for k in range(n))), path)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_csv(p: Plane, path: str) -> None:
    """A plane as CSV: a row a pixel row with its coordinate first, columns in order, blank for no data."""
    from pyspark.sql import functions as F

    if p.grid.width is None:
        raise ValueError("the plane's width is unknown")
    p.df.groupBy("y").pivot("x", list(range(p.grid.width))).agg(F.first("v")).orderBy("y").write.mode("overwrite").option("header", True).csv(path)


def export_tiles(p: Plane, path: str, tile: int = 512) -> None:
    """A plane as Parquet, a folder a row of tiles, so that windows read what they need."""
    from pyspark.sql import functions as F

    p.df.withColumn("ty", F.floor(F.col("y") / tile)).repartition("ty").sortWithinPartitions("y", "x").write.mode("overwrite").partitionBy("ty").parquet(path)
