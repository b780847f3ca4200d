from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry
from rasterloom.functions.polygons import rings_literal, shapes_meet
from rasterloom.operators import areas, catalog
from rasterloom.sources import tables

RING = "array<struct<x:double,y:double>>"


def closed(points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def inside(rings, x, y):
    """By the even-odd rule."""
    odd = False
    for ring in rings:
        for p, q in zip(ring, ring[1:]):
            if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                odd = not odd
    return odd


def segments(rings):
    return [((p["x"], p["y"]), (q["x"], q["y"])) for ring in rings for p, q in zip(ring, ring[1:])]


def turn(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def meet(a, b):
    """Two shapes share a point: exact for the small whole numbers used here."""
    for p, q in segments(a):
        for r, s in segments(b):
            if all(min(p[k], q[k]) <= max(r[k], s[k]) and min(r[k], s[k]) <= max(p[k], q[k]) for k in (0, 1)):
                if turn(p, q, r) * turn(p, q, s) <= 0 and turn(r, s, p) * turn(r, s, q) <= 0:
                    return True
    return any(inside(b, r[0]["x"], r[0]["y"]) for r in a) or any(inside(a, r[0]["x"], r[0]["y"]) for r in b)


def shape(draw, size, reach):
    """A triangle or a frame (a square with a square hole) on whole numbers."""
    x, y, r = draw.randint(-reach, reach), draw.randint(-reach, reach), draw.randint(1, size)
    if draw.random() < 0.5:
        while True:
            corners = [(x + draw.randint(-r, r), y + draw.randint(-r, r)) for _ in range(3)]
            if turn(*corners):
                return [closed(corners)]
    rings = [closed([(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)])]
    if r > 1:
        h = draw.randint(1, r - 1)
        rings.append(closed([(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h)]))
    return rings


def test_shapes_meet(spark):
    draw = random.Random(1)
    rows = [(i, shape(draw, 6, 6), shape(draw, 6, 6)) for i in range(1500)]
    df = spark.createDataFrame(rows, f"id int, a array<{RING}>, b array<{RING}>")
    got = {r.id: r.met for r in df.select("id", shapes_meet(F.col("a"), F.col("b")).alias("met")).collect()}
    want = {i: meet(a, b) for i, a, b in rows}
    assert got == want and 100 < sum(want.values()) < 1400
    assert spark.range(1).select(shapes_meet(F.lit(None).cast(f"array<{RING}>"), rings_literal([[(0, 0), (1, 0), (0, 1), (0, 0)]]))).first()[0] is False


def boxed(rings):
    xs, ys = [p["x"] for r in rings for p in r], [p["y"] for r in rings for p in r]
    return float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))


@pytest.mark.parametrize("scale, size, reach", [(1.0, 3, 40), (0.0625, 5, 60), (2.0, 30, 20)])
def test_items_meet_areas(spark, scale, size, reach):
    """Areas of all sizes, from far smaller than a cell to much of the globe, against every pair."""
    draw = random.Random(size)

    def scaled(rings):
        return [[{c: v * scale for c, v in p.items()} for p in r] for r in rings]

    items = [(i, *boxed(r), r[0]) for i in range(250) for r in [scaled([shape(draw, size, reach)[0]])]]
    items = [(i, *b, None if i % 5 == 0 else r) for i, *b, r in items]
    given = [(i, scaled(shape(draw, draw.choice([1, size, 4 * size if 4 * size * scale < 90 else size]), reach))) for i in range(30)]

    def own(i, a, b, c, d, ring):
        return [ring or closed([(c, b), (c, d), (a, d), (a, b)])]

    want = {(item[0], j) for item in items for j, rings in given if meet(own(*item), rings)}
    df = spark.createDataFrame(items, f"item_id int, minx double, miny double, maxx double, maxy double, ring {RING}")
    found = areas.meeting(df, spark.createDataFrame(given, f"area_id int, rings array<{RING}>"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.item_id for r in catalog.in_area(df, spark.createDataFrame(given, f"area_id int, rings array<{RING}>")).collect()} == {i for i, _ in want}


def test_cells_are_bounded(spark):
    """A box touches four cells of its own size at most, an area 17 x 17 of an eighth of it; the globe too."""
    draw = random.Random(9)
    rows = []
    for i in range(400):
        w, h = 360 * 2 ** -draw.uniform(0, 16), 180 * 2 ** -draw.uniform(0, 16)
        x, y = draw.uniform(-180, 180 - w), draw.uniform(-90, 90 - h)
        rows.append((i, x, y, x + w, y + h))
    df = spark.createDataFrame([*rows, (400, -180.0, -90.0, 180.0, 90.0)], "id int, minx double, miny double, maxx double, maxy double")
    box = {c: F.col(c) for c in areas.BOX}
    own, fine = areas.cells(box, areas.level_of(box)), areas.cells(box, areas.level_of(box, 1))
    most = df.select(F.max(F.size(own)), F.max(F.size(areas.with_coarser(own))), F.max(F.size(fine))).first()
    assert most[0] <= 4 and most[1] <= 4 * len(areas.LEVELS) and most[2] <= 17 * 17


def test_over_the_antimeridian(spark):
    """A box from 179 to -179 degrees meets areas on both sides, and none in between."""
    df = spark.createDataFrame([(1, 179.0, 0.0, -179.0, 1.0)], "item_id int, minx double, miny double, maxx double, maxy double")
    given = tables.areas(spark, (179.5, 0.5, 179.6, 0.6), (-179.6, 0.5, -179.5, 0.6), (0.0, 0.0, 1.0, 1.0), (-180.0, -90.0, 180.0, 90.0))
    assert sorted(r.area_id for r in areas.meeting(df, given).collect()) == [0, 1, 3]


def test_search_takes_the_polygon_itself(spark):
    """Neither an item in the corner that a triangle leaves free nor one in a hole is found; a MultiPolygon's parts both find."""
    boxes = {"corner": (0.8, 0.8, 0.9, 0.9), "inside": (0.1, 0.1, 0.2, 0.2), "edge": (0.5, 0.5, 0.6, 0.6), "hole": (5.4, 5.4, 5.6, 5.6), "frame": (5.1, 5.1, 5.2, 5.2)}
    df = spark.createDataFrame([(k, "sentinel-2-l2a", 1.0, *b) for k, b in boxes.items()], "item_id string, collection string, cloud_cover double, minx double, miny double, maxx double, maxy double").withColumn("datetime", F.lit("2023-06-01").cast("timestamp_ntz"))
    triangle = [[0, 0], [1, 0], [0, 1], [0, 0]]
    frame = [[[5, 5], [6, 5], [6, 6], [5, 6]], [[5.3, 5.3], [5.3, 5.7], [5.7, 5.7], [5.7, 5.3], [5.3, 5.3]]]
    for area, want in (({"type": "Polygon", "coordinates": [triangle]}, {"inside", "edge"}), ({"type": "MultiPolygon", "coordinates": [[triangle], frame]}, {"inside", "edge", "frame"}), ({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": frame}}, {"frame"})):
        assert {r.item_id for r in catalog.search(df, area, "2023-01-01", "2023-12-31").collect()} == want
    with pytest.raises(ValueError, match="polygon"):
        geometry.area_rings({"type": "Point", "coordinates": [0, 0]})


def test_there_and_back_in_less_than_a_millimetre(spark):
    draw = random.Random(2)
    rows = [(draw.uniform(-4.5, 4.5) + zone * 6 - 183, draw.uniform(-80, 84), zone) for zone in (1, 10, 31, 33, 60) for _ in range(200)]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int")
    south = F.col("lat") < 0
    east, north = geometry.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), south)
    there = df.select("*", east.alias("e"), north.alias("n"))
    lon, lat = geometry.from_utm(F.col("e"), F.col("n"), F.col("zone"), south)
    back = there.select("*", lon.alias("lon2"), lat.alias("lat2"))
    e2, n2 = geometry.to_utm(F.col("lon2"), F.col("lat2"), F.col("zone"), south)
    off = back.select(F.max(F.abs(e2 - F.col("e"))), F.max(F.abs(n2 - F.col("n"))), F.max(F.abs(F.col("lon") - F.col("lon2")) * F.cos(F.radians("lat"))), F.max(F.abs(F.col("lat") - F.col("lat2")))).first()
    assert max(off[:2]) < 1e-3 and max(off[2:]) * 111_000 < 1e-3


def pairs_of(spark, rows):
    names = ("epsg", "origin_x", "origin_y", "res_x", "res_y")
    return spark.createDataFrame(rows, "g int, source_g int, " + ", ".join(f"{p}{n} {'int' if n == 'epsg' else 'double'}" for p in ("", "source_") for n in names))


def test_reprojection_takes_the_cell_that_a_centre_falls_into(spark):
    """Across the border of two zones: the cell found holds the centre, by the projection of the cell's own corners."""
    here, there = (32610, 764000.0, 4188000.0, 10.0, -10.0), (32611, 235700.0, 4188300.0, 20.0, -20.0)
    pairs = pairs_of(spark, [(1, 7, *here, *there), (2, 7, *there, *there)])
    target = spark.range(2 * 30 * 30).select((F.col("id") % 2 + 1).cast("int").alias("g"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.floor(F.col("id") / 2) % 30).cast("int").alias("col"))
    source = spark.range(60 * 60).select(F.lit(7).alias("g"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), F.col("id").alias("v"))
    got = areas.reproject_match(target, source, pairs, ["g"], ["v"])
    assert got.columns == ["g", "row", "col", "v"] and got.count() == 1800
    assert got.filter("g = 2 and (v is null or v <> row * 60 + col)").count() == 0
    first = got.filter("g = 1").withColumns({"r": F.floor(F.col("v") / 60), "c": F.col("v") % 60})
    x, y = (geometry.pixel_centre(F.col(c), here[i], here[i + 2]) for c, i in (("col", 1), ("row", 2)))
    lon, lat = geometry.from_utm(x, y, F.lit(10))
    placed = first.withColumns({"lon": lon, "lat": lat})
    e, n = geometry.to_utm(F.col("lon"), F.col("lat"), F.lit(11))
    held = placed.filter("v is not null").filter(~(e.between(there[1] + F.col("c") * 20, there[1] + (F.col("c") + 1) * 20) & n.between(there[2] - (F.col("r") + 1) * 20, there[2] - F.col("r") * 20)))
    assert held.count() == 0 and first.filter("v is not null").count() > 300


def test_spans_equal_the_even_odd_rule(spark):
    """Areas of several rings over grids of two zones and hemispheres: pixels in spans are those that the rule has inside."""
    draw = random.Random(4)
    grid_rows = [(1, 32610, 544000.0, 4189000.0, 10.0, -10.0, 40, 50), (2, 32733, 500000.0, 6500000.0, 20.0, -20.0, 30, 30)]
    table = spark.createDataFrame(grid_rows, "g int, epsg int, origin_x double, origin_y double, res_x double, res_y double, height int, width int")
    px = table.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    px = px.select("g", "row", "col", geometry.pixel_centre(F.col("col"), F.col("origin_x"), F.col("res_x")).alias("x"), geometry.pixel_centre(F.col("row"), F.col("origin_y"), F.col("res_y")).alias("y"))
    given, local = [], {}
    for g, epsg, ox, oy, rx, ry, h, w in grid_rows:
        for a in range(6):
            def around(n, r, cx, cy):
                return [(cx + r * math.cos(6.283 * k / n + a), cy + r * math.sin(6.283 * k / n + a)) for k in range(n)]

            cx, cy, r = ox + draw.uniform(0, w) * rx, oy + draw.uniform(0, h) * ry, draw.uniform(2, 40) * rx
            local[g, a] = [closed(around(draw.randint(3, 9), r, cx, cy)), closed(around(5, r / 3, cx, cy)), closed(around(3, r / 4, cx + 2 * r, cy))]
            given.append((g, a, epsg, local[g, a]))
    raw = spark.createDataFrame(given, f"g int, area_id int, epsg int, rings array<{RING}>")

    def degrees(p):
        lon, lat = geometry.from_utm(p.x, p.y, F.col("epsg") % 100, F.floor(F.col("epsg") / 100) == 327)
        return F.struct(lon.alias("x"), lat.alias("y"))

    shapes = raw.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, degrees))).drop("epsg")
    got = {(r.g, r.area_id, r.row, r.col) for r in areas.clip_to_areas(px, shapes, table, ["g"]).collect()}
    want = {(p.g, a, p.row, p.col) for p in px.collect() for (g, a), rings in local.items() if g == p.g and inside(rings, p.x, p.y)}
    assert got == want and len(want) > 1500


def test_a_span_needs_no_expression_for_each_vertex(spark):
    """The plan over pixels doesn't grow with an area's vertices."""
    px = spark.range(10).select(F.lit(1).alias("g"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    table = spark.createDataFrame([(1, 32610, 0.0, 0.0, 10.0, -10.0, 5, 5)], "g int, epsg int, origin_x double, origin_y double, res_x double, res_y double, height int, width int")
    length = []
    for n in (4, 400):
        spark.createDataFrame([(1, 0, [closed([(math.cos(k * 6.28 / n), math.sin(k * 6.28 / n)) for k in range(n)])])], f"g int, area_id int, rings array<{RING}>").createOrReplaceTempView("shapes")
        length.append(len(areas.clip_to_areas(px, spark.table("shapes"), table, ["g"])._jdf.queryExecution().optimizedPlan().toString()))
    assert length[1] < 1.1 * length[0]

