"""Points and boxes as struct expressions, WKT text in and out, and a Z-order key for pruning."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: str | Column, y: str | Column) -> Column:
    a, b = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))


def _number(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def as_wkt(p: Column) -> Column:
    return F.concat(F.lit("POINT("), _number(p["x"]), F.lit(" "), _number(p["y"]), F.lit(")"))


def point_from_wkt(c: Column) -> Column:
    x, y = (F.regexp_extract(c, r"^\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$", i).try_cast("double") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def line_from_wkt(c: Column) -> Column:
    """A LINESTRING's points as an array."""
    body = F.regexp_extract(c, r"^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    pairs = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda t: F.split(t, r"\s+"))
    return F.when(body != "", F.transform(pairs, lambda a: F.struct(a[0].try_cast("double").alias("x"), a[1].try_cast("double").alias("y"))))


def length(line: Column) -> Column:
    steps = F.zip_with(line, F.slice(line, F.lit(2), F.size(line)), lambda a, b: F.when(b.isNotNull(), distance(a, b)).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def within_box(p: Column, left: float, low: float, right: float, high: float) -> Column:
    return p["x"].between(left, right) & p["y"].between(low, high)


def within_polygon(p: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the ring's edges."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            meets = ((F.lit(y1) > p["y"]) != (F.lit(y2) > p["y"])) & (p["x"] < (F.lit(x2 - x1) * (p["y"] - y1) / F.lit(y2 - y1) + x1))
            crossed = crossed + meets.cast("int")
    return crossed % 2 == 1


def z_order(p: Column, left: float, low: float, right: float, high: float, bits: int = 16) -> Column:
    """Interleaved bits of a point's cell: rows sorted by it are near each other, so that files' ranges prune box filters."""
    top = (1 << bits) - 1
    x, y = (F.least(F.greatest(F.floor((p[c] - a) / (b - a) * top), F.lit(0)), F.lit(top)).cast("long") for c, a, b in (("x", left, right), ("y", low, high)))
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(1), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(1), 2 * i + 1))
    return out


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)
