"""Colour maps: tables of colours read from text, and values looked up in them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Colour = tuple[float, float, float]


def read_map(text: str) -> list[tuple[float, Colour]]:
    """(place in 0..1, colour in 0..1) of each line of a colour-map file, in order.

    A line has r g b or place r g b (and maybe more, which is left out), apart by
    white space or commas; lines that begin with # or have no three numbers are
    left out. Colours over 1 are of 255; places are stretched to 0..1, even ones
    taken where there are none.
    """
    rows = []
    for line in text.splitlines():
        numbers = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", line)]
        if len(numbers) >= 3 and not line.lstrip().startswith("#"):
            rows.append(numbers)
    if not rows:
        raise ValueError("no colours")
    placed = all(len(r) >= 4 for r in rows) and all(a[0] < b[0] for a, b in zip(rows, rows[1:]))
    colours = [tuple(r[1:4] if placed else r[:3]) for r in rows]
    most = 255 if max(map(max, colours)) > 1 else 1
    places = [r[0] for r in rows] if placed else [float(k) for k in range(len(rows))]
    span = places[-1] - places[0] or 1.0
    return [((p - places[0]) / span, tuple(c / most for c in colour)) for p, colour in zip(places, colours)]


def colour(v: Column, table: Sequence[tuple[float, Colour]], reverse: bool = False) -> Column:
    """struct<r,g,b> in 0..255 of a stretched value in 0..1, linear between the places; NULL without a value."""
    table = [(1 - p, c) for p, c in reversed(table)] if reverse else list(table)
    known, v = v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    def channel(k: int) -> Column:
        out = F.lit(float(table[-1][1][k]))
        for (a, ca), (b, cb) in reversed(list(zip(table, table[1:]))):
            out = F.when(v <= b, ca[k] + (v - a) * ((cb[k] - ca[k]) / ((b - a) or 1.0))).otherwise(out)
        return F.floor(out * 255 + 0.5).cast("int")

    return F.when(known, F.struct(*(channel(k).alias(n) for k, n in enumerate("rgb"))))
