"""Queries over tables of areas, other reference systems, stored tiles, overviews and broken inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.operators import areas, catalog, grids, raster
from rasterloom.plans import pipeline
from rasterloom.plans.registry import AREA, AREA_SQL, CELL, CLOUD, GRID, IN_AREA, PLAIN, SEARCH, SQL_INDEX, YEAR, coarse_sql, grid_table, register
from rasterloom.sources import fixtures as fx
from rasterloom.sources import tables

N = geo.FLATTENING / (2 - geo.FLATTENING)
GRID_METRES = geo.GRID_SCALE * geo.MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)


def to_utm_sql(name: str, source: str, keep: str, middle: str, shift: str) -> str:
    """CTEs that project lon and lat of a relation to east and north."""
    alpha = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
    e = 2 * N**0.5 / (1 + N)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, a in enumerate(alpha, 1))])
    return (
        f"{name}_t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - {middle}) AS away FROM {source}), "
        f"{name}_u AS (SELECT *, atan(t / cos(away)) AS xi, atanh(sin(away) / sqrt(1e0 + t * t)) AS eta FROM {name}_t), "
        f"{name} AS (SELECT {keep}, 500000e0 + {GRID_METRES!r} * ({east}) AS east, {shift} + {GRID_METRES!r} * ({north}) AS north FROM {name}_u)"
    )


def from_utm_sql(name: str, source: str, keep: str, middle: str, shift: str) -> str:
    """CTEs that bring x and y of a relation back to lon and lat."""
    beta = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
    delta = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
    up = " - ".join(["xi", *(f"{b!r} * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, b in enumerate(beta, 1))])
    aside = " - ".join(["eta", *(f"{b!r} * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, b in enumerate(beta, 1))])
    lat = " + ".join(["chi", *(f"{d!r} * sin({2 * j}e0 * chi)" for j, d in enumerate(delta, 1))])
    return (
        f"{name}_a AS (SELECT *, (y - {shift}) / {GRID_METRES!r} AS xi, (x - 500000e0) / {GRID_METRES!r} AS eta FROM {source}), "
        f"{name}_b AS (SELECT *, {up} AS up, {aside} AS aside FROM {name}_a), {name}_c AS (SELECT *, asin(sin(up) / cosh(aside)) AS chi FROM {name}_b), "
        f"{name} AS (SELECT {keep}, degrees(atan(sinh(aside) / cos(up))) + {middle} AS lon, degrees({lat}) AS lat FROM {name}_c)"
    )


# ---- footprints and areas ----

RIGHT_OF = "(y1 > py) <> (y2 > py) AND px < (x2 - x1) * ((py - y1) / nullif(y2 - y1, 0e0)) + x1"


def side_sql(px: str, py: str, e: str) -> str:
    return f"sign(({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({e}.y2 - {e}.y1) * ({px} - {e}.x1))"


#: Pairs (item_id, area_id) of relations item_edge and area_edge whose shapes share a point, of the pairs in `near`.
MEETING_SQL = (
    "crossing AS (SELECT DISTINCT item_id, area_id FROM near JOIN item_edge a USING (item_id) JOIN area_edge b USING (area_id) WHERE "
    "least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) AND "
    f"{side_sql('a.x1', 'a.y1', 'b')} * {side_sql('a.x2', 'a.y2', 'b')} <= 0 AND {side_sql('b.x1', 'b.y1', 'a')} * {side_sql('b.x2', 'b.y2', 'a')} <= 0), "
    "item_start AS (SELECT item_id, x1 AS px, y1 AS py FROM item_edge WHERE i = 1), area_start AS (SELECT area_id, x1 AS px, y1 AS py FROM area_edge WHERE i = 1), "
    f"item_in AS (SELECT item_id, area_id FROM near JOIN item_start USING (item_id) JOIN area_edge USING (area_id) GROUP BY item_id, area_id HAVING count(*) FILTER (WHERE {RIGHT_OF}) % 2 = 1), "
    f"area_in AS (SELECT item_id, area_id FROM (SELECT item_id, area_id, px, py FROM near JOIN area_start USING (area_id)) JOIN item_edge USING (item_id) GROUP BY item_id, area_id, px, py HAVING count(*) FILTER (WHERE {RIGHT_OF}) % 2 = 1), "
    "met AS (SELECT * FROM crossing UNION SELECT * FROM item_in UNION SELECT item_id, area_id FROM area_in)"
)
#: The footprints' edges: diamonds in the scenes' boxes.
DIAMOND_SQL = (
    "ring AS (SELECT item_id, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y, 47e-3 AS r FROM scene), "
    "item_edge AS (SELECT item_id, 1 AS i, x AS x1, y - r AS y1, x + r AS x2, y AS y2 FROM ring UNION ALL SELECT item_id, 2, x + r, y, x, y + r FROM ring "
    "UNION ALL SELECT item_id, 3, x, y + r, x - r, y FROM ring UNION ALL SELECT item_id, 4, x - r, y, x, y - r FROM ring)"
)
BOXES_SQL = "area_box AS (SELECT area_id, min(x1) AS ax0, min(y1) AS ay0, max(x1) AS ax1, max(y1) AS ay1 FROM area_edge GROUP BY area_id), near AS (SELECT item_id, area_id FROM scene JOIN area_box ON minx <= ax1 AND maxx >= ax0 AND miny <= ay1 AND maxy >= ay0)"


@register("footprints_in_areas", f"WITH {fx.SCENE_SQL}, {fx.AREA_SQL}, {DIAMOND_SQL}, {BOXES_SQL}, {MEETING_SQL} SELECT item_id, area_id FROM met")
def footprints_in_areas(spark, d):
    """All pairs of a footprint and one of some triangles and frames that share a point."""
    return areas.meeting(fx.footprints(fx.scenes(spark, d)), fx.areas(spark, d))


@register("scenes_by_area", f"WITH {fx.SCENE_SQL}, {fx.AREA_SQL}, {DIAMOND_SQL}, {BOXES_SQL}, {MEETING_SQL} SELECT area_id, count(*) AS n, min(cloud_cover) AS least_cloud FROM met JOIN scene USING (item_id) GROUP BY area_id")
def scenes_by_area(spark, d):
    own = fx.footprints(fx.scenes(spark, d))
    return areas.meeting(own, fx.areas(spark, d)).join(own.select("item_id", "cloud_cover"), "item_id").groupBy("area_id").agg(F.count("*").alias("n"), F.min("cloud_cover").alias("least_cloud"))


#: A triangle, and a frame whose hole leaves items out.
SEARCHED = {"type": "MultiPolygon", "coordinates": [[[[-122.50, 37.75], [-122.40, 37.75], [-122.50, 37.85], [-122.50, 37.75]]], [[[-122.25, 37.60], [-122.05, 37.60], [-122.05, 37.95], [-122.25, 37.95], [-122.25, 37.60]], [[-122.23, 37.62], [-122.23, 37.93], [-122.07, 37.93], [-122.07, 37.62], [-122.23, 37.62]]]]}


def literal_edges_sql(area: dict) -> str:
    rows = [f"(0, {i}, {p[0]!r}e0, {p[1]!r}e0, {q[0]!r}e0, {q[1]!r}e0)" for polygon in area["coordinates"] for ring in polygon for i, (p, q) in enumerate(zip(ring, ring[1:]), 1)]
    return f"area_edge AS (SELECT * FROM (VALUES {', '.join(rows)}) v(area_id, i, x1, y1, x2, y2))"


@register(
    "scene_search_polygons",
    f"WITH {fx.SCENE_SQL}, {literal_edges_sql(SEARCHED)}, {DIAMOND_SQL}, {BOXES_SQL}, {MEETING_SQL} SELECT item_id, datetime FROM met JOIN scene USING (item_id) WHERE "
    + SEARCH.format(cloud=40).split(" AND minx")[0].split("\n  AND minx")[0],
)
def scene_search_polygons(spark, d):
    """The area as a MultiPolygon with a hole, not its box."""
    return catalog.search(fx.footprints(fx.scenes(spark, d)), SEARCHED, *YEAR, 40).select("item_id", "datetime")


# ---- pixels in areas ----

VERTEX_SQL = (
    "corner AS (SELECT area_id, ring, i, x1 AS lon, y1 AS lat FROM area_edge), "
    + to_utm_sql("moved", "corner", "area_id, ring, i", "-123e0", "0e0")
    + ", last AS (SELECT area_id, ring, max(i) AS n FROM moved GROUP BY area_id, ring), "
    "side AS (SELECT p.area_id, p.area_id % 8 AS grid_id, p.east AS x1, p.north AS y1, q.east AS x2, q.north AS y2 FROM moved p JOIN last USING (area_id, ring) JOIN moved q ON q.area_id = p.area_id AND q.ring = p.ring AND q.i = p.i % last.n + 1), "
    "extent AS (SELECT area_id, grid_id, min(x1) AS ax0, max(x1) AS ax1, min(y1) AS ay0, max(y1) AS ay1 FROM side GROUP BY ALL), "
    "inside AS (SELECT p.grid_id, p.row, p.col, s.area_id FROM pixel p JOIN extent e ON e.grid_id = p.grid_id AND p.x BETWEEN ax0 AND ax1 AND p.y BETWEEN ay0 AND ay1 JOIN side s ON s.area_id = e.area_id "
    "WHERE (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < (s.x2 - s.x1) * (p.y - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"
)


@register("clip_areas", f"WITH {fx.PIXEL_SQL}, {fx.GRID_AREA_SQL}, {VERTEX_SQL} SELECT grid_id, row, col, CAST(area_id AS INTEGER) AS area_id, red, nir FROM pixel JOIN inside USING (grid_id, row, col)")
def clip_areas(spark, d):
    """Areas in degrees with holes, projected for their grids and cut out by scan lines."""
    return areas.clip_to_areas(fx.pixels(spark, d), fx.grid_areas(spark, d), grid_table(spark, d), GRID).select(*CELL, "area_id", "red", "nir")


MASKED_SQL = f"m AS (SELECT grid_id, row, col, area_id, {', '.join(f'CASE WHEN NOT {CLOUD} THEN CAST(nullif({b}, 0) AS DOUBLE) * 1e-4 END AS {b}' for b in ('red', 'green', 'blue', 'nir', 'swir2'))} FROM pixel JOIN inside USING (grid_id, row, col))"


@register("explore_areas", f"WITH {fx.PIXEL_SQL}, {fx.GRID_AREA_SQL}, {VERTEX_SQL}, {MASKED_SQL} SELECT grid_id, row, col, CAST(area_id AS INTEGER) AS area_id, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in PLAIN)} FROM m")
def explore_areas(spark, d):
    return pipeline.explore_areas(fx.pixels(spark, d), fx.grid_areas(spark, d), grid_table(spark, d)).select(*CELL, "area_id", *PLAIN)


# ---- other reference systems ----

def reference_sql(side: int, i: int) -> str:
    return f"CASE WHEN grid_id % 2 = 0 THEN {fx.REFERENCES[0][side][i]!r} ELSE {fx.REFERENCES[1][side][i]!r} END"


@register(
    "resample_reprojected",
    f"WITH {fx.PIXEL_SQL}, {fx.COARSE_SQL}, target AS (SELECT grid_id, row, col, nir, CAST({reference_sql(0, 1)} AS DOUBLE) + (col + 5e-1) * 10e0 AS x, CAST({reference_sql(0, 2)} AS DOUBLE) + (row + 5e-1) * -10e0 AS y FROM pixel), "
    + from_utm_sql("degree", "target", "grid_id, row, col, nir", "(CASE WHEN grid_id % 2 = 0 THEN -123 ELSE 15 END)", "(CASE WHEN grid_id % 2 = 0 THEN 0e0 ELSE 10000000e0 END)")
    + ", "
    + to_utm_sql("moved", "degree", "grid_id, row, col, nir", "(CASE WHEN grid_id % 2 = 0 THEN -117 ELSE 21 END)", "(CASE WHEN grid_id % 2 = 0 THEN 0e0 ELSE 10000000e0 END)")
    + f", cell AS (SELECT grid_id, row, col, nir, CAST(floor((north - {reference_sql(1, 2)}) / -20e0) AS INTEGER) AS r, CAST(floor((east - {reference_sql(1, 1)}) / 20e0) AS INTEGER) AS c FROM moved) "
    "SELECT cell.grid_id, cell.row, cell.col, nir, swir2, scl FROM cell LEFT JOIN coarse ON coarse.grid_id = cell.grid_id AND coarse.row = r AND coarse.col = c",
)
def resample_reprojected(spark, d):
    """20 m bands of grids in the neighbouring zone, on both hemispheres."""
    px = fx.pixels(spark, d)
    return areas.reproject_match(px.select(*CELL, "nir"), fx.coarse_pixels(px), fx.references(spark), GRID, ["swir2", "scl"], scenes=fx.GRIDS).select(*CELL, "nir", "swir2", "scl")


# ---- stored tiles and overviews ----

@register("stored_area_window", f"WITH {fx.PIXEL_SQL}, {AREA_SQL} SELECT grid_id AS scene_id, row, col, nir FROM pixel WHERE grid_id % 2 = 1 AND {IN_AREA}")
def stored_area_window(spark, d):
    """An area in degrees, read from the tiles that it touches of every second stored scene."""
    path = tables.shared_path(spark, "tiles")
    tables.write_pixels(fx.pixels(spark, d).withColumnRenamed("grid_id", "scene_id"), path, tile=16)
    px = tables.read_pixels(spark, path)
    scenes = grids.measured(px, ["scene_id"], 32610, fx.ORIGIN, fx.RES).filter("scene_id % 2 = 1")
    cut = grids.clip_to_area(px, scenes, AREA, ["scene_id"], most=fx.GRIDS, tile=16)
    return cut.select(F.col("scene_id").cast("long").alias("scene_id"), "row", "col", "nir")


def ladder_sql(factors: tuple[int, ...], bands: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({f} AS INTEGER) AS factor, * FROM ({coarse_sql(f, bands)})" for f in factors)


@register("overview_ladder", ladder_sql((2, 4, 8, 16), ("red", "nir")))
def overview_ladder(spark, d):
    return raster.overviews(fx.pixels(spark, d), GRID, (2, 4, 8, 16), ["red", "nir"], scenes=fx.GRIDS)


# ---- broken inputs ----

def stac_line(cut: bool = False):
    """An item of the test tables as JSON; every 97th is cut off, others lack a time, a box or an id."""
    item, quote = F.col("item_id").cast("string"), '"'
    head = F.concat(F.lit('{"id":"'), F.when(F.col("item_id") % 89 == 0, "").otherwise(item), F.lit('","collection":"'), F.col("collection"), F.lit(quote))
    time = F.when(F.col("item_id") % 83 == 0, F.lit("null")).otherwise(F.concat(F.lit(quote), F.date_format("datetime", "yyyy-MM-dd"), F.lit('T00:00:00Z"')))
    box = F.when(F.col("item_id") % 79 == 0, F.lit("[1,2]")).otherwise(F.lit("[1,2,3,4]"))
    rest = F.concat(F.lit(',"properties":{"datetime":'), time, F.lit('},"bbox":'), box, F.lit("}"))
    return F.when(F.col("item_id") % 97 == 0, F.concat(head, F.lit(',"proper'))).otherwise(F.concat(head, rest))


@register(
    "quarantined_items",
    f"WITH {fx.SCENE_SQL}, j AS (SELECT CASE WHEN item_id % 97 = 0 THEN 'not a readable item' WHEN item_id % 89 = 0 THEN 'no id' WHEN item_id % 83 = 0 THEN 'no time' WHEN item_id % 79 = 0 THEN 'no box' ELSE 'usable' END AS reason FROM scene) SELECT reason, count(*) AS n FROM j GROUP BY reason",
)
def quarantined_items(spark, d):
    """A catalogue with broken lines: how many are usable, and how many are left out for which reason."""
    path = tables.shared_path(spark, "broken")
    fx.scenes(spark, d).select(stac_line().alias("value")).write.text(path)
    usable, rejected = tables.checked_stac(spark, path)
    both = usable.select(F.lit("usable").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "quarantined_files",
    f"WITH {fx.PIXEL_SQL} SELECT grid_id, CASE grid_id WHEN 3 THEN 'no value of nir' WHEN 5 THEN 'no readable row' ELSE 'usable' END AS reason, CASE WHEN grid_id NOT IN (3, 5) THEN count(*) ELSE 0 END AS n FROM pixel GROUP BY grid_id",
)
def quarantined_files(spark, d):
    """Pixel files of which one lacks a band and one is no Parquet: the others' pixels are counted."""
    path = tables.shared_path(spark, "files")
    px = fx.pixels(spark, d).select("grid_id", F.col("grid_id").alias("scene_id"), "row", "col", "x", "y", "red", "nir")
    px.filter("grid_id not in (3, 5)").write.partitionBy("grid_id").parquet(path)
    px.filter("grid_id = 3").drop("nir").write.partitionBy("grid_id").mode("append").parquet(path)
    px.filter("grid_id = 5").select("grid_id", F.lit("not a pixel").alias("value")).limit(1).write.partitionBy("grid_id").mode("append").text(path)
    usable, rejected = tables.checked_pixels(spark, path, ("red", "nir"))
    grid = F.regexp_extract("file", r"/grid_id=(\d+)/", 1).cast("long").alias("grid_id")
    good = usable.groupBy(F.col("scene_id").cast("long").alias("grid_id")).agg(F.lit("usable").alias("reason"), F.count("*").alias("n"))
    return good.unionByName(rejected.select(grid, "reason", F.lit(0).cast("long").alias("n")).distinct())
