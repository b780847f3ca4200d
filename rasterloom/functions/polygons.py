"""Polygons as Column expressions: a shape is an array of closed rings, outer ones and holes alike, inside by the even-odd rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rings_literal(rings: list[list[tuple[float, float]]]) -> Column:
    return F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring)) for ring in rings))


def edges(rings: Column) -> Column:
    """All edges (x1, y1, x2, y2) of a shape."""

    def of(ring: Column) -> Column:
        last = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(F.slice(ring, F.lit(1), last), F.slice(ring, F.lit(2), last), lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))

    return F.flatten(F.transform(rings, of))


def box_of(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def side(px: Column, py: Column, e: Column) -> Column:
    """On which side of an edge a point lies: 1, 0 (on its line) or -1."""
    return F.signum((e.x2 - e.x1) * (py - e.y1) - (e.y2 - e.y1) * (px - e.x1))


def edges_meet(a: Column, b: Column) -> Column:
    """Whether two edges share a point; touching counts."""
    near = F.lit(True)
    for c in "xy":
        a1, a2, b1, b2 = a[f"{c}1"], a[f"{c}2"], b[f"{c}1"], b[f"{c}2"]
        near = near & (F.least(a1, a2) <= F.greatest(b1, b2)) & (F.least(b1, b2) <= F.greatest(a1, a2))
    return near & (side(a.x1, a.y1, b) * side(a.x2, a.y2, b) <= 0) & (side(b.x1, b.y1, a) * side(b.x2, b.y2, a) <= 0)


def holds(borders: Column, x: Column, y: Column) -> Column:
    """Whether a shape, given by its edges, has a point inside: an odd number of edges is to the right of it."""

    def one(inside: Column, e: Column) -> Column:
        right = ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * F.try_divide(y - e.y1, e.y2 - e.y1) + e.x1)
        return inside != F.coalesce(right, F.lit(False))

    return F.aggregate(borders, F.lit(False), one)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, though body names it often or within other functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shapes_meet(a: Column, b: Column) -> Column:
    """Whether two shapes share a point: their borders meet, or one lies within the other. A shape in another's hole doesn't
    meet it; null shapes meet nothing."""

    def met(borders: Column) -> Column:
        own, given = borders.own, borders.given
        within = F.exists(a, lambda ring: holds(given, ring[0].x, ring[0].y)) | F.exists(b, lambda ring: holds(own, ring[0].x, ring[0].y))
        return F.exists(own, lambda e: F.exists(given, lambda g: edges_meet(e, g))) | within

    return F.coalesce(let(F.struct(edges(a).alias("own"), edges(b).alias("given")), met), F.lit(False))


def box_within(minx: Column, miny: Column, maxx: Column, maxy: Column, rings: Column) -> Column:
    """Whether a box lies wholly inside a shape: no border passes through it, and a corner is inside."""
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))
    sides = edges(F.array(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))))

    def within(borders: Column) -> Column:
        passed = F.exists(borders.own, lambda e: F.exists(borders.sides, lambda g: edges_meet(e, g)) | (e.x1.between(minx, maxx) & e.y1.between(miny, maxy)))
        return ~passed & holds(borders.own, minx, miny)

    return let(F.struct(edges(rings).alias("own"), sides.alias("sides")), within)
