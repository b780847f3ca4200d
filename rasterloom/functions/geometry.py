"""Areas of interest, boxes and map projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE, LEAST_KM, MOST_KM = 111.0, 1.0, 200.0


def check_size(width_km: float, height_km: float) -> None:
    for v in (width_km, height_km):
        if not LEAST_KM <= v <= MOST_KM:
            raise ValueError(f"an area's side must be between {LEAST_KM:g} and {MOST_KM:g} km")


def check_dates(start: str, end: str) -> None:
    if str(start) > str(end):
        raise ValueError("the start date is after the end date")


def check_area(area) -> None:
    if area is None:
        raise ValueError("no area of interest")


def box_around(lat: Column, lon: Column, width: Column, height: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy in degrees of a box of so many km around a point."""
    dlat = height / 2 / F.lit(KM_PER_DEGREE)
    dlon = width / 2 / (F.lit(KM_PER_DEGREE) * F.abs(F.cos(F.radians(lat))))
    return {"minx": lon - dlon, "miny": lat - dlat, "maxx": lon + dlon, "maxy": lat + dlat}


def area_rings(area) -> list[list[tuple[float, float]]]:
    """All closed rings, outer ones and holes, of a box given as (minx, miny, maxx, maxy), a GeoJSON Polygon or MultiPolygon."""
    check_area(area)
    if not isinstance(area, dict):
        minx, miny, maxx, maxy = map(float, area)
        return [[(maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny), (maxx, miny)]]
    if area.get("type") == "Feature":
        return area_rings(area["geometry"])
    parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(area.get("type", "Polygon"))
    if parts is None:
        raise ValueError(f"an area must be a polygon, not a {area['type']}")
    rings = [[(float(p[0]), float(p[1])) for p in ring] for polygon in parts(area["coordinates"]) for ring in polygon if ring]
    if not rings:
        raise ValueError("no area of interest")
    return [ring if ring[0] == ring[-1] else [*ring, ring[0]] for ring in rings]


def area_box(area) -> tuple[float, float, float, float]:
    """Bounds of an area."""
    if area is not None and not isinstance(area, dict):
        return tuple(map(float, area))
    points = [p for ring in area_rings(area) for p in ring]
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The closed ring of a box, counter-clockwise from its lower right corner."""

    def at(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(at(maxx, miny), at(maxx, maxy), at(minx, maxy), at(minx, miny), at(maxx, miny))


def feature_collection(ring: Column) -> Column:
    """A GeoJSON FeatureCollection with one polygon, as text."""
    points = F.transform(ring, lambda p: F.array(p.x, p.y))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))


def envelope(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def box_centre(box: Column) -> dict[str, Column]:
    """lat and lon of the centre of an array [minlon, minlat, maxlon, maxlat]."""
    return {"lat": (box[1] + box[3]) / 2, "lon": (box[0] + box[2]) / 2}


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share a point; touching counts."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def ring_meets_box(ring: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Whether a closed ring of points (x, y) and a literal box share a point: a vertex lies in the box, a corner in the ring,
    or an edge crosses a side. Null for a null ring."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    vertex = F.exists(ring, lambda p: p.x.between(minx, maxx) & p.y.between(miny, maxy))

    def crosses(at: float, low: float, high: float, along: str, across: str) -> Column:
        def one(e: Column) -> Column:
            a1, a2, c1, c2 = e[f"{along}1"], e[f"{along}2"], e[f"{across}1"], e[f"{across}2"]
            return F.coalesce(((a1 <= at) != (a2 <= at)) & (c1 + (c2 - c1) * F.try_divide(F.lit(at) - a1, a2 - a1)).between(low, high), F.lit(False))

        return F.exists(edges, one)

    def holds(x: float, y: float) -> Column:
        def one(inside: Column, e: Column) -> Column:
            cut = ((e.y1 > y) != (e.y2 > y)) & (F.lit(x) < (e.x2 - e.x1) * F.try_divide(F.lit(y) - e.y1, e.y2 - e.y1) + e.x1)
            return inside != F.coalesce(cut, F.lit(False))

        return F.aggregate(edges, F.lit(False), one)

    sides = crosses(minx, miny, maxy, "x", "y") | crosses(maxx, miny, maxy, "x", "y") | crosses(miny, minx, maxx, "y", "x") | crosses(maxy, minx, maxx, "y", "x")
    return vertex | sides | holds(minx, miny)  # without a crossing all corners are inside, or none


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a ring of literal vertices, closed or not."""
    points = ring if ring[0] != ring[-1] else ring[:-1]
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
        inside = inside != crosses
    return inside


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


#: The WGS 84 ellipsoid and the universal transverse Mercator grid.
MAJOR, FLATTENING, GRID_SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series of the third order in n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - F.lit(e) * F.atanh(F.lit(e) * sine))
    away = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan(t / F.cos(away)), F.atanh(F.sin(away) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    shift = F.lit(0.0) if south is None else F.when(south, FALSE_NORTH).otherwise(0.0)
    return F.lit(FALSE_EAST) + F.lit(GRID_SCALE * radius) * east, shift + F.lit(GRID_SCALE * radius) * north


def from_utm(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude of a point of the grid: to_utm turned round, to less than a millimetre."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    shift = F.lit(0.0) if south is None else F.when(south, FALSE_NORTH).otherwise(0.0)
    xi, eta = (north - shift) / F.lit(GRID_SCALE * radius), (east - F.lit(FALSE_EAST)) / F.lit(GRID_SCALE * radius)
    up, aside = xi, eta
    for j, b in enumerate(beta, 1):
        up = up - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        aside = aside - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(up) / F.cosh(aside))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.degrees(F.atan(F.sinh(aside) / F.cos(up))) + (zone * 6 - 183), F.degrees(lat)


def window_of(minx: Column, miny: Column, maxx: Column, maxy: Column, origin_x: float, origin_y: float, res_x: float, res_y: float) -> dict[str, Column]:
    """Fractional offsets and sizes of a box in a grid (res_y is negative), and the whole rows and columns that it touches."""
    col, row = (minx - origin_x) / F.lit(res_x), (maxy - origin_y) / F.lit(res_y)
    right, down = (maxx - origin_x) / F.lit(res_x), (miny - origin_y) / F.lit(res_y)
    return {
        "col_off": col,
        "row_off": row,
        "width": right - col,
        "height": down - row,
        "col_start": F.floor(col).cast("long"),
        "row_start": F.floor(row).cast("long"),
        "col_stop": F.ceil(right).cast("long"),
        "row_stop": F.ceil(down).cast("long"),
    }


def pixel_centre(index: Column, origin: float | Column, step: float | Column) -> Column:
    """The coordinate of a pixel's centre; never summed up step by step."""
    origin, step = (v if isinstance(v, Column) else F.lit(v) for v in (origin, step))
    return origin + (index + F.lit(0.5)) * step
