"""Catalogs of products and items: search, best item of a tile, code tables, names, attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def under_cloud(items: DataFrame, most: float, cloud: str = "cloud") -> DataFrame:
    """Items of at most `most` percent cloud; those with unknown cloud stay."""
    return items.where(F.col(cloud).isNull() | (F.col(cloud) <= most))


def best_per_tile(items: DataFrame, tile: str = "tile", cloud: str = "cloud", order: str = "seq") -> DataFrame:
    """The item of each tile with the least cloud (unknown counts as 0), ties to the first read."""
    w = Window.partitionBy(tile).orderBy(F.coalesce(F.col(cloud), F.lit(0.0)), order)
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tile_key(grid_code: Column, zone: Column, band: Column, square: Column, item: Column) -> Column:
    """grid:code, else UTM zone, band and square together, else the item's own id."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(some(grid_code), F.concat(some(zone), some(band), some(square)), some(item))


def lookup(df: DataFrame, codes: DataFrame, keys: Sequence[str], order: str = "priority") -> DataFrame:
    """Each row with the first code row that fits: a NULL key in the code table fits anything, and the row with the least `order` wins.

    Rows are matched by their distinct keys, so a table of codes is compared
    with the few combinations that occur and not with every row.
    """
    names = [c for c in codes.columns if c not in (*keys, order)]
    distinct = df.select(*keys).distinct()
    table = codes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(order).alias("_order"), *names)
    fits = F.lit(True)
    for k in keys[1:]:
        fits = fits & (F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(k)))
    # The first key is an equi-join: exact codes and wildcards are two branches.
    exact = distinct.join(table, (F.col(f"_{keys[0]}") == F.col(keys[0])) & fits)
    anything = distinct.withColumn("_any", F.lit(1)).join(table.where(F.col(f"_{keys[0]}").isNull()).withColumn("_any", F.lit(1)), "_any").where(fits).drop("_any")
    w = Window.partitionBy(*keys).orderBy("_order")
    best = exact.unionByName(anything).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, *names)
    return df.join(best, list(keys), "left")


def nearest_group(variables: DataFrame, coords: DataFrame, dim: str = "dim", where: str = "dir") -> DataFrame:
    """For each variable's dimension, the coordinate variable of that name in the nearest parent group (the longest directory that contains it)."""
    c = coords.select(F.col(dim).alias("_dim"), F.col(where).alias("_dir"), F.struct("*").alias("coord"))
    inside = F.startswith(F.concat(F.col(where), F.lit("/")), F.concat(F.col("_dir"), F.when(F.col("_dir") == "", F.lit("")).otherwise(F.lit("/"))))
    pairs = variables.join(c, (F.col(dim) == F.col("_dim")) & inside)
    return pairs.groupBy(*variables.columns).agg(F.max_by("coord", F.length("_dir")).alias("coord"))


def first_of_duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def union_of_files(variables: DataFrame, name: str = "name", file: str = "file", order: Sequence[str] = ("reflectance", "radiance")) -> DataFrame:
    """Variables of several files as one list: a name in more than one file gets the file's as a prefix; kinds in `order` first, then by name."""
    times = F.count("*").over(Window.partitionBy(name))
    out = variables.withColumn("title", F.when(times > 1, F.concat(F.col(file), F.lit("/"), F.col(name))).otherwise(F.col(name)))
    rank = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        rank = F.when(F.contains(F.lower(name), F.lit(order[k])), k).otherwise(rank)
    return out.withColumn("rank", rank).orderBy("rank", "title")


def search_attributes(attributes: DataFrame, text: str) -> DataFrame:
    """Attributes whose name or value holds a text, whatever the case."""
    want = F.lit(text.lower())
    return attributes.where(F.contains(F.lower("k"), want) | F.contains(F.lower("v"), want))


def fuzzy(name: Column, typed: str) -> Column:
    """Score of letters typed in order: the first one's place plus the gaps between them; NULL if they don't all occur. Less is better."""
    low = F.lower(name)
    place, first = F.lit(0), None
    missing = F.lit(False)
    for ch in typed.lower():
        at = F.locate(ch, low, 1) if first is None else F.call_function("locate", F.lit(ch), low, place + 1)
        missing = missing | (at == 0)
        first = at if first is None else first
        place = at
    if first is None:
        return F.lit(0)
    return F.when(~missing, (first - 1) + (place - first - (len(typed) - 1)))


def clean_path(path: Column) -> Column:
    """A path or URL without query, fragment and user information."""
    return F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What is before the last slash, empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def identifier(name: Column) -> Column:
    """A name for the expression language: the leaf in lower case, `band 3` as b3, other characters as _, no _ at the ends, no digit first."""
    low = F.lower(leaf(name))
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]", "_"), "^_+|_+$", "")
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("b"), plain)).otherwise(plain)
    return F.when(low.rlike(r"^band\s*\d+$"), F.concat(F.lit("b"), F.regexp_extract(low, r"(\d+)$", 1))).otherwise(plain)


def group_tree(variables: DataFrame, path: str = "path") -> DataFrame:
    """(group, n): every group on the way to a variable and how many lie below it."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(k < F.size(parts), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return variables.select(F.explode(prefixes).alias("group")).where("group is not null").groupBy("group").agg(F.count("*").alias("n"))


def attribute_pairs(json: Column) -> Column:
    """A JSON object as ordered (k, v) pairs of text; nested values as JSON. NULL if it is none."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def xml_texts(xml: Column, path: str) -> Column:
    """The texts of the elements or attributes at an XPath, in document order: names without their prefixes' meaning."""
    plain = F.regexp_replace(F.regexp_replace(xml, r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", ""), r"(</?)\w+:", "$1")
    return F.transform(F.xpath(plain, F.lit(path if "/@" in path else path.rstrip("/") + "/text()")), lambda x: F.trim(x))


def number_text(v: Column) -> Column:
    """Up to four decimals without trailing zeros; below a thousandth and from a million on with an exponent."""
    a = F.abs(v)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.format_string("%.3e", v), r"e\+?(-?)0*(\d)", "e$1$2")
    return F.when(v.isNull() | F.isnan(v) | (a == float("inf")), F.lit("no data")).when((a != 0) & ((a < 1e-3) | (a >= 1e6)), exponent).otherwise(fixed)


def rounded_text(v: float, error: float) -> str:
    """A value with the decimals (six at most) that its error permits, without trailing zeros."""
    import math

    if not math.isfinite(v) or not error > 0:
        return "no data" if not math.isfinite(v) else f"{v:.4f}".rstrip("0").rstrip(".")
    text = f"{v:.{min(6, max(0, math.ceil(-math.log10(error))))}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def time_bounds(fields: DataFrame, by: Sequence[str], t: str = "t") -> DataFrame:
    """Valid time range of each product."""
    return fields.groupBy(*by).agg(F.min(t).alias("valid_from"), F.max(t).alias("valid_to"))


def _half_up(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def length_text(meters: Column) -> Column:
    """Meters with one decimal, from 10 km on kilometers with two."""
    return F.when(meters >= 10_000, F.concat(number_text(_half_up(meters / 10) / 100), F.lit(" km"))).otherwise(F.concat(number_text(_half_up(meters * 10) / 10), F.lit(" m")))


def area_text(square_meters: Column) -> Column:
    """Whole square meters, from a square kilometer on square kilometers with two decimals."""
    return F.when(square_meters >= 1e6, F.concat(number_text(_half_up(square_meters / 1e4) / 100), F.lit(" km²"))).otherwise(F.concat(number_text(_half_up(square_meters)), F.lit(" m²")))


def round_length(x: float) -> float:
    """The largest of 1, 2 and 5 times a power of ten that isn't over x."""
    import math

    base = 10.0 ** math.floor(math.log10(x))
    return max(m * base for m in (1, 2, 5) if m * base <= x * (1 + 1e-12))


def ticks(lo: float, hi: float, about: int = 6) -> tuple[list[float], float]:
    """Round places of an axis and their step: of the round steps the one that gives the number of intervals nearest to `about`, the finer of two."""
    import math

    lo, hi = min(lo, hi), max(lo, hi)
    span = hi - lo
    if not 0 < span < math.inf:
        return [lo], 1.0
    unit = 10.0 ** math.floor(math.log10(span / about))
    # The round steps, in units of a power of ten.
    step = min((m * unit for m in (1, 2, 2.5, 5, 10, 20)), key=lambda s: abs(span / s - about))
    places = range(math.ceil(lo / step), math.floor(hi / step + 1e-9) + 1)
    return [k * step for k in places], step


def tick_text(v: float, step: float) -> str:
    """A value of an axis with as many decimals, six at most, as its step has."""
    digits = next((d for d in range(7) if abs(round(step * 10**d) - step * 10**d) < 1e-6 * step * 10**d), 6)
    text = f"{v:.{digits}f}"
    return text if text.strip("-0.") else "0"


def log_ticks(lo: float, hi: float) -> list[float]:
    """1, 2 and 5 times powers of ten within lo and hi."""
    import math

    out = [m * 10.0**e for e in range(math.floor(math.log10(lo)), math.ceil(math.log10(hi)) + 1) for m in (1, 2, 5)]
    return [v for v in out if lo * (1 - 1e-12) <= v <= hi * (1 + 1e-12)]


def describe(variables: DataFrame) -> DataFrame:
    """name, shape text, storage text of variables(name, dims, shape, chunk, dtype, codec)."""
    shape = F.array_join(F.zip_with("dims", "shape", lambda d, n: F.concat(d, F.lit(" "), n.cast("string"))), " × ")
    return variables.select("name", shape.alias("shape_text"), F.concat_ws(", ", F.concat(F.lit("chunks "), F.array_join(F.transform("chunk", lambda c: c.cast("string")), "×")), "dtype", "codec").alias("storage"))


def product_list(text: DataFrame, folder: str, line: str = "value") -> DataFrame:
    """(path): the lines of a list of products (one a row), without empty ones and those after #; relative paths lie in `folder`."""
    path = F.trim(F.col(line))
    absolute = path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)")
    return text.where((path != "") & ~path.startswith("#")).select(F.when(absolute, path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path)).alias("path"))


def address(url: str) -> tuple[str, str, str]:
    """(path, kind, text) of path#name (variable), path#wind and path#=expression; kind is empty without a #."""
    path, mark, rest = url.partition("#")
    if not mark:
        return path, "", ""
    return (path, "expression", rest[1:]) if rest.startswith("=") else (path, "wind" if rest == "wind" else "variable", "" if rest == "wind" else rest)


def dated_urls(spark, first: str, last: str, pattern: str) -> DataFrame:
    """(day, url): one URL a day from first to last, by a pattern of Spark's date_format with the rest of the URL in quotes."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")
    return days.select("day", F.date_format("day", pattern).alias("url"))


def pages_of(fetch, url: str, most: int = 1000):
    """All items of a paged search: fetch(url) gives (items, next url or None). Ends at a page without a next one or one seen before."""
    seen: set[str] = set()
    while url and url not in seen and len(seen) < most:
        seen.add(url)
        items, url = fetch(url)
        yield from items


def asked(dims: Sequence[tuple[str, int]], axes: Sequence[str], time: str | None = None) -> bool:
    """Whether a variable leaves a question open: a dimension of several values that is neither an axis of the image nor time."""
    return any(n > 1 and d not in axes and d != time for d, n in dims)


def step_index(index: int, by: int, size: int) -> int:
    """The next or previous index, held inside."""
    return max(0, min(size - 1, index + by))


def axis_values(size: int, times: Sequence[float] | None = None, coordinates: Sequence[float] | None = None, start: float | None = None, step: float | None = None) -> list[float]:
    """Values along an axis: its times, else its coordinates, else the centres by start and step, else the indices; a list that doesn't fit the size is passed over."""
    for values in (times, coordinates):
        if values is not None and len(values) == size:
            return list(map(float, values))
    return [start + (k + 0.5) * step for k in range(size)] if start is not None and step else [float(k) for k in range(size)]


def index_text(index: int, name: str, values: Sequence | None = None, units: str = "") -> str:
    """An index with its coordinate, if there is one: `level 3 (500 hPa)`."""
    if values is None or not 0 <= index < len(values):
        return f"{name} {index}"
    v = values[index]
    text = f"{v:g}" if isinstance(v, float) else str(v)
    return f"{name} {index} ({text} {units})" if units else f"{name} {index} ({text})"


def points_of(text: Column) -> Column:
    """The points (x, y) of a text with one a line, two numbers apart by white space, comma or semicolon; other lines are left out."""
    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    line = rf"^\s*{number}\s*[\s,;]\s*{number}\s*$"
    points = F.transform(F.split(text, r"\r?\n"), lambda s: F.when(s.rlike(line), F.struct(F.regexp_extract(s, line, 1).cast("double").alias("x"), F.regexp_extract(s, line, 2).cast("double").alias("y"))))
    return F.filter(points, lambda p: p.isNotNull())
