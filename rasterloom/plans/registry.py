"""The engine's registered queries and their SQL, over scenes and pixels viewed in the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions.indices import CLASSES, INDICES, index, index_class
from rasterloom.functions.scalar import first_tile
from rasterloom.operators import catalog, grids, raster, render
from rasterloom.plans import pipeline
from rasterloom.schemas import CLOUD_CLASSES
from rasterloom.sources import fixtures as fx
from rasterloom.sources import tables
from rasterloom.sources.tables import areas

AREA = (-122.50, 37.75, -122.40, 37.85)
YEAR = ("1997-01-01", "1997-12-31")
BOX = (544050.0, 4188600.0, 544560.0, 4189300.0)
#: A rotated quadrangle over the grids.
RING = [(544010.0, 4189000.0), (544300.0, 4189330.0), (544600.0, 4188900.0), (544250.0, 4188500.0)]
GRID = ["grid_id"]
CELL = ["grid_id", "row", "col"]
PLAIN = ("ndvi", "evi", "ndwi_mcfeeters", "nbr")
DOCUMENTED = ("savi", "ndre", "mndwi", "ndmi", "nbr2", "bai", "ndbi")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}

SEARCH = """collection IN ('sentinel-2-l2a') AND datetime >= TIMESTAMP '1997-01-01' AND datetime < TIMESTAMP '1998-01-01' AND cloud_cover < {cloud}
  AND minx <= -122.40e0 AND maxx >= -122.50e0 AND miny <= 37.85e0 AND maxy >= 37.75e0"""
MONTHLY = """row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(cloud_cover, 100e0), datetime DESC, item_id) AS r"""
SCALED = "scaled AS (SELECT grid_id, row, col, x, y, scl, " + ", ".join(f"CAST({b} AS DOUBLE) * 1e-4 AS {b}" for b in ("red", "green", "blue", "nir", "swir1", "swir2", "b05", "b8a")) + " FROM pixel)"
CLOUD = "coalesce(scl IN (3, 8, 9, 10, 11), FALSE)"


def ratio(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0e0)"


SQL_INDEX = {
    "ndvi": ratio("nir", "red"),
    "evi": "2.5e0 * (nir - red) / nullif(nir + 6e0 * red - 7.5e0 * blue + 1e0, 0e0)",
    "ndwi_mcfeeters": ratio("green", "nir"),
    "nbr": ratio("nir", "swir2"),
    "red_edge_ndvi": ratio("b8a", "b05"),
    "savi": "1.5e0 * (nir - red) / nullif(nir + red + 5e-1, 0e0)",
    "ndre": ratio("nir", "b05"),
    "mndwi": ratio("green", "swir1"),
    "ndmi": ratio("nir", "swir1"),
    "nbr2": ratio("swir1", "swir2"),
    "bai": "1e0 / nullif((1e-1 - red) * (1e-1 - red) + (6e-2 - nir) * (6e-2 - nir), 0e0)",
    "ndbi": ratio("swir1", "nir"),
    "ndvi_safe": "(nir - red) / nullif(nir + red + 1e-6, 0e0)",
    "nbr_safe": "(nir - swir2) / nullif(nir + swir2 + 1e-6, 0e0)",
    "ndwi_nir_swir2_safe": "(nir - swir2) / nullif(nir + swir2 + 1e-6, 0e0)",
}


def sql_class(name: str) -> str:
    parts = []
    for low, high, label in CLASSES[name]:
        bounds = [f"{name} >= CAST({low} AS DOUBLE)"] * (low is not None) + [f"{name} < CAST({high} AS DOUBLE)"] * (high is not None)
        parts.append(f"WHEN {' AND '.join(bounds)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END AS {name}_class"


def register(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return keep


def items(spark: SparkSession, d: str, cloud: float = 40) -> DataFrame:
    return catalog.search(fx.scenes(spark, d), AREA, *YEAR, cloud)


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return raster.scale_bands(fx.pixels(spark, d))


# ---- catalogue ----

@register("scene_search", f"WITH {fx.SCENE_SQL} SELECT item_id, datetime, cloud_cover FROM scene WHERE {SEARCH.format(cloud=40)}")
def scene_search(spark, d):
    return items(spark, d).select("item_id", "datetime", "cloud_cover")


@register("scene_search_narrow", f"WITH {fx.SCENE_SQL} SELECT item_id, cloud_cover FROM scene WHERE {SEARCH.format(cloud=20)} AND datetime >= TIMESTAMP '1997-06-01' AND datetime < TIMESTAMP '1997-07-01'")
def scene_search_narrow(spark, d):
    return catalog.search(fx.scenes(spark, d), AREA, "1997-06-01", "1997-06-30", 20).select("item_id", "cloud_cover")


@register("scene_count", f"WITH {fx.SCENE_SQL} SELECT count(*) AS n FROM scene WHERE {SEARCH.format(cloud=60)}")
def scene_count(spark, d):
    return catalog.count(items(spark, d, 60))


@register(
    "scenes_in_areas",
    f"WITH {fx.SCENE_SQL} SELECT item_id FROM scene WHERE (minx <= -122.40e0 AND maxx >= -122.50e0 AND miny <= 37.85e0 AND maxy >= 37.75e0) OR (minx <= -122.20e0 AND maxx >= -122.25e0 AND miny <= 37.60e0 AND maxy >= 37.55e0)",
)
def scenes_in_areas(spark, d):
    return catalog.in_area(fx.scenes(spark, d), areas(spark, AREA, (-122.25, 37.55, -122.20, 37.60))).select("item_id")


@register("scene_labels", f"WITH {fx.SCENE_SQL} SELECT item_id, CAST(item_id AS VARCHAR) || ' — ' || CAST(CAST(datetime AS DATE) AS VARCHAR) || ' — Cloud ' || coalesce(CAST(cloud_cover AS VARCHAR), 'N/A') || '%' AS label FROM scene")
def scene_labels(spark, d):
    return catalog.labelled(fx.scenes(spark, d)).select("item_id", "label")


@register("scene_pick", f"WITH {fx.SCENE_SQL} SELECT item_id, datetime FROM scene WHERE CAST(item_id AS VARCHAR) || ' — ' || CAST(CAST(datetime AS DATE) AS VARCHAR) || ' — Cloud ' || coalesce(CAST(cloud_cover AS VARCHAR), 'N/A') || '%' = '53 — ' || (SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) FROM scene WHERE item_id = 53) || ' — Cloud N/A%' ORDER BY datetime, item_id LIMIT 1")
def scene_pick(spark, d):
    own = fx.scenes(spark, d)
    shown = catalog.labelled(own).filter("item_id = 53").select("label").first()  # what the user has chosen from a list
    return catalog.pick(own, shown.label if shown else "").select("item_id", "datetime")


@register("scene_search_footprint", f"WITH {fx.SCENE_SQL}, hit AS (SELECT * FROM scene WHERE {SEARCH.format(cloud=40)}) SELECT hit.item_id, hit.datetime FROM hit JOIN base ON base.item_id = hit.item_id WHERE {fx.FOOTPRINT}")
def scene_search_footprint(spark, d):
    return catalog.search(fx.footprints(fx.scenes(spark, d)), AREA, *YEAR, 40).select("item_id", "datetime")


@register("scene_search_geojson", f"WITH {fx.SCENE_SQL} SELECT item_id, datetime FROM scene WHERE {SEARCH.format(cloud=40)}")
def scene_search_geojson(spark, d):
    """The area as a GeoJSON polygon."""
    minx, miny, maxx, maxy = AREA
    polygon = {"type": "Polygon", "coordinates": [[[maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny], [maxx, miny]]]}
    return catalog.search(fx.scenes(spark, d), polygon, *YEAR, 40).select("item_id", "datetime")


@register("session_scenes", f"WITH {fx.SCENE_SQL} SELECT grid_id, count(*) AS n FROM scene WHERE {SEARCH.format(cloud=40)} GROUP BY grid_id")
def session_scenes(spark, d):
    """What a search found is kept in the session and queried by SQL."""
    catalog.remember(items(spark, d), "rasterloom_found")
    return spark.sql("SELECT grid_id, count(*) AS n FROM rasterloom_found GROUP BY grid_id")


@register("stac_search", f"WITH {fx.SCENE_SQL}, hit AS (SELECT * FROM scene WHERE {SEARCH.format(cloud=40)}) SELECT CAST(hit.item_id AS VARCHAR) AS item_id, hit.datetime, hit.cloud_cover FROM hit JOIN base ON base.item_id = hit.item_id WHERE {fx.FOOTPRINT}")
def stac_search(spark, d):
    """The catalogue as STAC JSON, read again and searched."""
    path = tables.shared_path(spark, "stac")
    tables.write_stac(fx.footprints(fx.scenes(spark, d)), path)
    return catalog.search(tables.read_stac(spark, path), AREA, *YEAR, 40).select("item_id", "datetime", "cloud_cover")


@register("items_search", f"WITH {fx.SCENE_SQL}, hit AS (SELECT * FROM scene WHERE {SEARCH.format(cloud=20)}) SELECT hit.item_id, hit.datetime FROM hit JOIN base ON base.item_id = hit.item_id WHERE {fx.FOOTPRINT}")
def items_search(spark, d):
    """The catalogue as Parquet, read again and searched: all bounds reach its scan."""
    path = tables.shared_path(spark, "items")
    fx.footprints(fx.scenes(spark, d)).write.parquet(path)
    return catalog.search(tables.read_items(spark, path), AREA, *YEAR, 20).select("item_id", "datetime")


@register("rendered_preview", f"WITH {fx.SCENE_SQL} SELECT item_id, 'https://data.example.com/' || item_id || '/rendered_preview.tif' AS preview FROM scene")
def rendered_preview(spark, d):
    return catalog.asset(fx.footprints(fx.scenes(spark, d)), "rendered_preview", "preview").select("item_id", "preview")


@register("monthly_least_cloudy", f"WITH {fx.SCENE_SQL}, f AS (SELECT *, month(datetime) AS month FROM scene WHERE {SEARCH.format(cloud=60)}), g AS (SELECT *, {MONTHLY.format(keys='month')} FROM f) SELECT item_id, datetime, CAST(month AS INTEGER) AS month, cloud_cover FROM g WHERE r = 1")
def monthly_least_cloudy(spark, d):
    return catalog.by_date(catalog.least_cloudy(items(spark, d, 60))).select("item_id", "datetime", "month", "cloud_cover")


@register("year_month_least_cloudy", f"WITH {fx.SCENE_SQL}, f AS (SELECT *, month(datetime) AS month, year(datetime) AS year FROM scene), g AS (SELECT *, {MONTHLY.format(keys='year, month')} FROM f) SELECT item_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM g WHERE r = 1")
def year_month_least_cloudy(spark, d):
    return catalog.least_cloudy(fx.scenes(spark, d), by_year=True).select("item_id", "year", "month")


@register("scene_first", f"WITH {fx.SCENE_SQL} SELECT item_id, datetime FROM scene WHERE {SEARCH.format(cloud=40)} ORDER BY datetime DESC, item_id LIMIT 1")
def scene_first(spark, d):
    return catalog.newest(items(spark, d)).select("item_id", "datetime")


@register("scene_nth", f"WITH {fx.SCENE_SQL} SELECT item_id, datetime FROM scene WHERE {SEARCH.format(cloud=60)} ORDER BY datetime, item_id LIMIT 1 OFFSET 2")
def scene_nth(spark, d):
    return catalog.nth(items(spark, d, 60), 2).select("item_id", "datetime")


@register(
    "skipped_scenes",
    f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL} SELECT item_id, 'no pixel in the area' AS reason FROM scene WHERE grid_id NOT IN (SELECT grid_id FROM pixel WHERE x BETWEEN 544050e0 AND 544560e0 AND y BETWEEN 4189325e0 AND 4189330e0 AND red > 3950)",
)
def skipped_scenes(spark, d):
    own = fx.scenes(spark, d)
    there = raster.clip(fx.pixels(spark, d), (544050.0, 4189325.0, 544560.0, 4189330.0)).filter("red > 3950").select("grid_id").distinct()
    return catalog.skipped(own, own.join(there, "grid_id", "left_semi"), "item_id")


# ---- pixel algebra ----

BANDS = ", ".join(raster.REFLECTANCE_BANDS)


@register("scale_bands", f"WITH {fx.PIXEL_SQL}, {SCALED} SELECT grid_id, row, col, {BANDS}, CAST(scl AS DOUBLE) * 1e-4 AS scl FROM scaled")
def scale_bands(spark, d):
    return raster.scale_bands(fx.pixels(spark, d), include_scl=True).select(*CELL, *raster.REFLECTANCE_BANDS, "scl")


@register("optional_bands", f"WITH {fx.PIXEL_SQL}, {SCALED} SELECT grid_id, row, col, red, nir, CAST(NULL AS INTEGER) AS swir2 FROM scaled")
def optional_bands(spark, d):
    """A table without an optional band: what is there is scaled, the band is added as nulls."""
    px = raster.scale_bands(fx.pixels(spark, d).drop("swir2"))
    return grids.with_bands(px, ["red", "swir2"]).select(*CELL, "red", "nir", "swir2")


@register("nodata_mask", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, {', '.join(f'nullif({b}, 0) AS {b}' for b in raster.REFLECTANCE_BANDS)} FROM pixel")
def nodata_mask(spark, d):
    return raster.mask_nodata(fx.pixels(spark, d)).select(*CELL, *raster.REFLECTANCE_BANDS)


@register("cloud_mask", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, scl, {', '.join(f'CASE WHEN NOT {CLOUD} THEN {b} END AS {b}' for b in raster.REFLECTANCE_BANDS)} FROM pixel")
def cloud_mask(spark, d):
    return raster.mask_clouds(fx.pixels(spark, d)).select(*CELL, "scl", *raster.REFLECTANCE_BANDS)


def index_query(name: str, names: tuple[str, ...]) -> None:
    @register(name, f"WITH {fx.PIXEL_SQL}, {SCALED} SELECT grid_id, row, col, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in names)} FROM scaled")
    def run(spark, d):
        return scaled(spark, d).select(*CELL, *(index(n) for n in names))


index_query("indices_safe", ("ndvi_safe", "nbr_safe", "ndwi_nir_swir2_safe"))
index_query("indices_plain", PLAIN)
index_query("indices_registry", DOCUMENTED)
index_query("red_edge_ndvi", ("red_edge_ndvi",))


@register("index_classes", f"WITH {fx.PIXEL_SQL}, {SCALED}, v AS (SELECT grid_id, row, col, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in CLASSES)} FROM scaled) SELECT grid_id, row, col, {', '.join(map(sql_class, CLASSES))} FROM v")
def index_classes(spark, d):
    values = scaled(spark, d).select(*CELL, *(index(n) for n in CLASSES))
    return values.select(*CELL, *(index_class(n).alias(f"{n}_class") for n in CLASSES))


@register("scene_ndvi_mean", f"WITH {fx.PIXEL_SQL}, {SCALED} SELECT grid_id, round(avg(CASE WHEN NOT {CLOUD} THEN {SQL_INDEX['ndvi_safe']} END), 6) AS ndvi FROM scaled GROUP BY grid_id")
def scene_ndvi_mean(spark, d):
    return raster.mask_clouds(scaled(spark, d)).select("grid_id", index("ndvi_safe")).groupBy("grid_id").agg(F.round(F.avg("ndvi_safe"), 6).alias("ndvi"))


# ---- grids ----

SIZE = "size AS (SELECT grid_id, max(row) + 1 AS h, max(col) + 1 AS w FROM pixel GROUP BY grid_id)"


def coarse_sql(f: int, bands: tuple[str, ...], more: str = "") -> str:
    means = ", ".join(f"avg({b}) AS {b}" for b in bands) + more
    return f"WITH {fx.PIXEL_SQL}, {SIZE} SELECT grid_id, CAST(row // {f} AS INTEGER) AS brow, CAST(col // {f} AS INTEGER) AS bcol, {means} FROM pixel JOIN size USING (grid_id) WHERE row < h // {f} * {f} AND col < w // {f} * {f} GROUP BY ALL"


@register("coarsen_mean", coarse_sql(2, ("red", "nir"), ", avg(x) AS x, avg(y) AS y"))
def coarsen_mean(spark, d):
    return raster.coarsen(fx.pixels(spark, d), GRID, 2, ["red", "nir"], scenes=fx.GRIDS)


@register("quicklook", coarse_sql(20, ("red", "nir")))
def quicklook(spark, d):
    return render.quicklook(fx.pixels(spark, d), GRID, ["red", "nir"], scenes=fx.GRIDS)


@register("resample_nearest", f"WITH {fx.PIXEL_SQL}, {fx.COARSE_SQL} SELECT p.grid_id, p.row, p.col, p.nir, c.swir2, c.scl FROM pixel p LEFT JOIN coarse c ON c.grid_id = p.grid_id AND c.row = p.row // 2 AND c.col = p.col // 2")
def resample_nearest(spark, d):
    px = fx.pixels(spark, d)
    return raster.resample_nearest(px.select(*CELL, "nir"), fx.coarse_pixels(px), GRID, ["swir2", "scl"]).select(*CELL, "nir", "swir2", "scl")


@register("resample_by_position", f"WITH {fx.PIXEL_SQL}, {fx.COARSE_SQL} SELECT p.grid_id, p.row, p.col, c.swir2 FROM pixel p LEFT JOIN coarse c ON c.grid_id = p.grid_id AND c.row = CAST(floor((p.y - 4189335e0) / -20e0) AS INTEGER) AND c.col = CAST(floor((p.x - 543985e0) / 20e0) AS INTEGER)")
def resample_by_position(spark, d):
    px = fx.pixels(spark, d)
    return raster.resample_by_position(px.select(*CELL, "x", "y"), fx.coarse_pixels(px), GRID, ["swir2"], (543985.0, 4189335.0), (20.0, -20.0)).select(*CELL, "swir2")


IN_BOX = "x BETWEEN 544050e0 AND 544560e0 AND y BETWEEN 4188600e0 AND 4189300e0"


def clip_query(name: str, mode: str) -> None:
    @register(name, f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, x, y, nir FROM pixel WHERE {IN_BOX}")
    def run(spark, d):
        return raster.clip(fx.pixels(spark, d), BOX, mode=mode).select(*CELL, "x", "y", "nir")


clip_query("clip_window", "window")
clip_query("clip_box", "box")


@register("stored_window", f"WITH {fx.PIXEL_SQL} SELECT grid_id AS scene_id, row, col, x, y, nir FROM pixel WHERE grid_id < 4 AND {IN_BOX}")
def stored_window(spark, d):
    """A pixel table written for window reads, and one window of some scenes read from it: folders and row groups are pruned."""
    path = tables.shared_path(spark, "pixels")
    tables.write_pixels(fx.pixels(spark, d).withColumnRenamed("grid_id", "scene_id"), path)
    px = tables.read_pixels(spark, path).filter("scene_id < 4")
    return raster.clip(px, BOX, mode="window").select(F.col("scene_id").cast("long").alias("scene_id"), "row", "col", "x", "y", "nir")


def ring_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True):
        parts.append(f"CAST((({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y)) AND x < {x2 - x1}::DOUBLE * (y - {y1}::DOUBLE) / {y2 - y1}::DOUBLE + {x1}::DOUBLE AS INTEGER)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@register("clip_polygon", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, CASE WHEN {ring_sql()} THEN red END AS red, CASE WHEN {ring_sql()} THEN nir END AS nir FROM pixel WHERE x BETWEEN 544010e0 AND 544600e0 AND y BETWEEN 4188500e0 AND 4189330e0")
def clip_polygon(spark, d):
    return raster.clip(fx.pixels(spark, d), ring=RING, mode="polygon").select(*CELL, "red", "nir")


@register("pixel_coords", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, x, y FROM pixel")
def pixel_coords(spark, d):
    return raster.with_coordinates(fx.pixels(spark, d).drop("x", "y"), fx.ORIGIN, fx.RES).select(*CELL, "x", "y")


ALIGNED = "a AS (SELECT grid_id, row, col, red FROM pixel WHERE NOT coalesce(scl IN (3, 8, 9, 10, 11), FALSE)), b AS (SELECT grid_id, row, col, nir FROM pixel WHERE nir > green)"


def two_bands(spark: SparkSession, d: str) -> list[DataFrame]:
    """Red where no cloud is, and near infrared where it outshines green: tables of different pixels."""
    px = fx.pixels(spark, d)
    clear = ~F.coalesce(F.col("scl").isin(*CLOUD_CLASSES), F.lit(False))
    return [px.filter(clear).select(*CELL, "red"), px.filter("nir > green").select(*CELL, "nir")]


@register("dataset_outer_align", f"WITH {fx.PIXEL_SQL}, {ALIGNED} SELECT grid_id, row, col, red, nir FROM a FULL JOIN b USING (grid_id, row, col)")
def dataset_outer_align(spark, d):
    return raster.aligned(two_bands(spark, d), CELL)


@register("dataset_inner_align", f"WITH {fx.PIXEL_SQL}, {ALIGNED} SELECT grid_id, row, col, red, nir FROM a JOIN b USING (grid_id, row, col)")
def dataset_inner_align(spark, d):
    return raster.aligned(two_bands(spark, d), CELL, "inner")


@register("band_stack_long", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, band, value FROM pixel UNPIVOT INCLUDE NULLS (value FOR band IN (red, green, blue))")
def band_stack_long(spark, d):
    return raster.stacked(fx.pixels(spark, d), CELL, ["red", "green", "blue"])


# ---- products ----

@register("rgb_stretch", f"WITH {fx.PIXEL_SQL}, {SCALED}, e AS (SELECT grid_id, min(least(red, green, blue)) AS lo, max(greatest(red, green, blue)) AS hi FROM scaled GROUP BY grid_id) SELECT grid_id, row, col, {', '.join(f'CAST(floor(({b} - lo) / (hi - lo + 1e-6) * 255) AS INTEGER) AS {b}' for b in render.RGB)} FROM scaled JOIN e USING (grid_id)")
def rgb_stretch(spark, d):
    return render.rgb_stretch(scaled(spark, d), GRID, scenes=fx.GRIDS).select(*CELL, *render.RGB)


@register("true_color_clip", f"WITH {fx.PIXEL_SQL}, {SCALED} SELECT grid_id, row, col, {', '.join(f'CASE WHEN {b} IS NOT NULL THEN least(greatest({b}, 0e0), 3e-1) END AS {b}' for b in render.RGB)} FROM scaled")
def true_color_clip(spark, d):
    return render.true_color(scaled(spark, d)).select(*CELL, *render.RGB)


@register(
    "ndvi_histogram",
    f"WITH {fx.PIXEL_SQL}, {SCALED}, v AS (SELECT grid_id, {SQL_INDEX['ndvi']} AS v FROM scaled), e AS (SELECT grid_id, min(v) AS mn, max(v) AS mx FROM v WHERE v IS NOT NULL GROUP BY grid_id), "
    "c AS (SELECT grid_id, CAST(least(coalesce(floor((v - mn) / nullif((mx - mn) / 50e0, 0e0)), 0), 49) AS INTEGER) + 1 AS bin, count(*) AS n FROM v JOIN e USING (grid_id) WHERE v IS NOT NULL GROUP BY ALL) "
    "SELECT e.grid_id, CAST(b.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM e CROSS JOIN (SELECT unnest(generate_series(1, 50)) AS bin) b LEFT JOIN c ON c.grid_id = e.grid_id AND c.bin = b.bin",
)
def ndvi_histogram(spark, d):
    return render.histogram(scaled(spark, d).select("grid_id", index("ndvi")), GRID, "ndvi", scenes=fx.GRIDS)


@register("ndvi_cross_section", f"WITH {fx.PIXEL_SQL}, {SCALED}, m AS (SELECT grid_id, (max(row) + 1) // 2 AS row FROM scaled GROUP BY grid_id) SELECT s.grid_id, s.row, s.col, {SQL_INDEX['ndvi']} AS ndvi FROM scaled s JOIN m ON m.grid_id = s.grid_id AND m.row = s.row")
def ndvi_cross_section(spark, d):
    return render.cross_section(scaled(spark, d).select(*CELL, index("ndvi")), GRID, "ndvi", scenes=fx.GRIDS)


@register("scl_distribution", f"WITH {fx.PIXEL_SQL} SELECT grid_id, scl, count(*) AS n FROM pixel GROUP BY ALL")
def scl_distribution(spark, d):
    return render.class_distribution(fx.pixels(spark, d), GRID)


@register("index_range", f"WITH {fx.PIXEL_SQL}, {SCALED}, v AS (SELECT grid_id, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in PLAIN)} FROM scaled) " + " UNION ALL ".join(f"SELECT grid_id, '{n}' AS \"index\", min({n}) AS low, max({n}) AS high FROM v GROUP BY grid_id" for n in PLAIN))
def index_range(spark, d):
    return render.value_range(scaled(spark, d).select("grid_id", *(index(n) for n in PLAIN)), GRID, list(PLAIN))


@register("index_panel", f"WITH {fx.PIXEL_SQL}, {SCALED}, v AS (SELECT grid_id, row, col, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in PLAIN)} FROM scaled) SELECT grid_id, row, col, {', '.join(f'CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, -1e0), 1e0) END AS {n}' for n in PLAIN)} FROM v")
def index_panel(spark, d):
    return render.colour_scaled(scaled(spark, d).select(*CELL, *(index(n) for n in PLAIN)), list(PLAIN))


# ---- areas ----

SPOTS = "spot AS (SELECT c_custkey AS id, CAST(c_custkey % 120 - 60 AS DOUBLE) + 2.5e-1 AS lat, CAST(c_custkey % 300 - 150 AS DOUBLE) + 5e-1 AS lon, CAST(c_custkey % 199 + 1 AS DOUBLE) AS km FROM customer)"


def spots(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return fx.read(spark, d, "customer").select(key.alias("id"), ((key % 120 - 60).cast("double") + 0.25).alias("lat"), ((key % 300 - 150).cast("double") + 0.5).alias("lon"), (key % 199 + 1).cast("double").alias("km"))


@register("aoi_from_center", f"WITH {SPOTS} SELECT id, floor((lon - km / 2 / (111e0 * abs(cos(radians(lat))))) * 1e8 + 5e-1) / 1e8 AS minx, lat - km / 2 / 111e0 AS miny, floor((lon + km / 2 / (111e0 * abs(cos(radians(lat))))) * 1e8 + 5e-1) / 1e8 AS maxx, lat + km / 2 / 111e0 AS maxy FROM spot")
def aoi_from_center(spark, d):
    box = geo.box_around(F.col("lat"), F.col("lon"), F.col("km"), F.col("km"))

    def cut(c):  # cosines may differ in their last bit
        return F.floor(c * F.lit(1e8) + F.lit(0.5)).cast("double") / F.lit(1e8)

    return spots(spark, d).select("id", cut(box["minx"]).alias("minx"), box["miny"].alias("miny"), cut(box["maxx"]).alias("maxx"), box["maxy"].alias("maxy"))


@register("aoi_bounds", f"WITH {fx.SCENE_SQL} SELECT item_id, minx, miny, maxx, maxy FROM scene")
def aoi_bounds(spark, d):
    ring = geo.box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return fx.scenes(spark, d).select("item_id", ring.alias("ring")).select("item_id", *(c.alias(n) for n, c in geo.envelope(F.col("ring")).items()))


@register("bbox_center", f"WITH {fx.SCENE_SQL} SELECT item_id, (miny + maxy) / 2 AS lat, (minx + maxx) / 2 AS lon FROM scene")
def bbox_center(spark, d):
    centre = geo.box_centre(F.array("minx", "miny", "maxx", "maxy"))
    return fx.scenes(spark, d).select("item_id", *(c.alias(n) for n, c in centre.items()))


def utm_sql(middle: str = "-123e0", more: str = "item_id", shift: str = "") -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    scale = geo.GRID_SCALE * geo.MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, a in enumerate(alpha, 1))])
    rest = more.removeprefix("item_id")
    return (
        f"t AS (SELECT {more}, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - {middle}) AS away FROM centre), "
        f"u AS (SELECT {more}, atan(t / cos(away)) AS xi, atanh(sin(away) / sqrt(1e0 + t * t)) AS eta FROM t) "
        f"SELECT item_id, floor((500000e0 + {scale!r} * ({east})) * 1e3 + 5e-1) / 1e3 AS east, floor(({shift}{scale!r} * ({north})) * 1e3 + 5e-1) / 1e3 AS north{rest} FROM u"
    )


@register("aoi_to_utm", f"WITH {fx.SCENE_SQL}, centre AS (SELECT item_id, (miny + maxy) / 2 AS lat, (minx + maxx) / 2 AS lon FROM scene), {utm_sql()}")
def aoi_to_utm(spark, d):
    east, north = geo.to_utm((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, F.lit(10))

    def cut(c):  # to the millimetre
        return F.floor(c * F.lit(1e3) + F.lit(0.5)).cast("double") / F.lit(1e3)

    return fx.scenes(spark, d).select("item_id", cut(east).alias("east"), cut(north).alias("north"))


@register("aoi_to_utm_zones", f"WITH {SPOTS}, centre AS (SELECT id AS item_id, lat, lon, CAST(floor((lon + 180e0) / 6) AS INTEGER) + 1 AS zone FROM spot), " + utm_sql("(zone * 6 - 183)", "item_id, zone, lat", "CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END + "))
def aoi_to_utm_zones(spark, d):
    """Points of both hemispheres, each in its own zone."""
    zone = geo.utm_zone(F.col("lon"))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), zone, F.col("lat") < 0)

    def cut(c):  # to the millimetre
        return F.floor(c * F.lit(1e3) + F.lit(0.5)).cast("double") / F.lit(1e3)

    return spots(spark, d).select(F.col("id").alias("item_id"), cut(east).alias("east"), cut(north).alias("north"), zone.alias("zone"), "lat")


WINDOW_BOX = "(543990e0 + (item_id % 50) * 7e0) AS bx0, (4188000e0 + (item_id % 40) * 9e0) AS by0, (544300e0 + (item_id % 50) * 7e0) AS bx1, (4188500e0 + (item_id % 40) * 9e0) AS by1"


@register("aoi_window", f"WITH {fx.SCENE_SQL}, b AS (SELECT item_id, {WINDOW_BOX} FROM scene) SELECT item_id, (bx0 - 543990e0) / 10e0 AS col_off, (by1 - 4189340e0) / -10e0 AS row_off, (bx1 - 543990e0) / 10e0 - (bx0 - 543990e0) / 10e0 AS width, (by0 - 4189340e0) / -10e0 - (by1 - 4189340e0) / -10e0 AS height, CAST(floor((bx0 - 543990e0) / 10e0) AS BIGINT) AS col_start, CAST(floor((by1 - 4189340e0) / -10e0) AS BIGINT) AS row_start, CAST(ceil((bx1 - 543990e0) / 10e0) AS BIGINT) AS col_stop, CAST(ceil((by0 - 4189340e0) / -10e0) AS BIGINT) AS row_stop FROM b")
def aoi_window(spark, d):
    i, j = (F.col("item_id") % 50) * F.lit(7.0), (F.col("item_id") % 40) * F.lit(9.0)
    window = geo.window_of(F.lit(543990.0) + i, F.lit(4188000.0) + j, F.lit(544300.0) + i, F.lit(4188500.0) + j, *fx.ORIGIN, *fx.RES)
    return fx.scenes(spark, d).select("item_id", *(c.alias(n) for n, c in window.items()))


@register("aoi_geojson", "WITH b AS (SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) + 2.5e-1 AS x0, CAST(n_nationkey AS DOUBLE) + 5e-1 AS y0 FROM nation) SELECT id, '{\"type\":\"FeatureCollection\",\"features\":[{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[[' || (x0 + 1) || ',' || y0 || '],[' || (x0 + 1) || ',' || (y0 + 1) || '],[' || x0 || ',' || (y0 + 1) || '],[' || x0 || ',' || y0 || '],[' || (x0 + 1) || ',' || y0 || ']]]}}]}' AS geojson FROM b")
def aoi_geojson(spark, d):
    x0, y0 = F.col("n_nationkey").cast("double") + 0.25, F.col("n_nationkey").cast("double") + 0.5
    return fx.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), geo.feature_collection(geo.box_ring(x0, y0, x0 + 1, y0 + 1)).alias("geojson"))


@register("geocode_lookup", f"WITH {fx.PLACE_SQL} SELECT name, lat, lon, address FROM place WHERE lower(name) = 'nation_7' ORDER BY name, address LIMIT 1")
def geocode_lookup(spark, d):
    return catalog.geocode(fx.places(spark, d), " Nation_7 ")


@register("tilejson_first", f"WITH {fx.TILE_SQL} SELECT event_id, json_extract_string(body, '$.tiles[0]') AS tile FROM tile")
def tilejson_first(spark, d):
    return fx.tile_documents(spark, d).select("event_id", first_tile(F.col("body")).alias("tile"))


# ---- grids' metadata ----

@register("grid_sizes", f"WITH {fx.PIXEL_SQL} SELECT grid_id, max(row) + 1 AS height, max(col) + 1 AS width, 32610 AS epsg, 543990e0 AS origin_x, 4189340e0 AS origin_y, 10e0 AS res_x, -10e0 AS res_y FROM pixel GROUP BY grid_id")
def grid_sizes(spark, d):
    return grids.measured(fx.pixels(spark, d), GRID, 32610, fx.ORIGIN, fx.RES)


@register("pixels_referenced", f"WITH {fx.PIXEL_SQL} SELECT grid_id, row, col, 32610 AS epsg, x, y FROM pixel")
def pixels_referenced(spark, d):
    px = fx.pixels(spark, d)
    return grids.referenced(px.select(*CELL), grids.measured(px, GRID, 32610, fx.ORIGIN, fx.RES), GRID, scenes=fx.GRIDS)


@register("scene_reference", f"WITH {fx.PIXEL_SQL} SELECT DISTINCT grid_id, 32610 AS epsg FROM pixel WHERE grid_id = 3")
def scene_reference(spark, d):
    return grids.reference_of(grids.measured(fx.pixels(spark, d), GRID, 32610, fx.ORIGIN, fx.RES), "grid_id", 3)


@register("window_transform", f"WITH {fx.SCENE_SQL}, b AS (SELECT item_id, {WINDOW_BOX} FROM scene), w AS (SELECT item_id, (bx0 - 543990e0) / 10e0 AS c0, (by1 - 4189340e0) / -10e0 AS r0 FROM b) SELECT item_id, 10e0 AS a, 543990e0 + c0 * 10e0 AS c, -10e0 AS e, 4189340e0 + r0 * -10e0 AS f FROM w")
def window_transform(spark, d):
    i, j = (F.col("item_id") % 50) * F.lit(7.0), (F.col("item_id") % 40) * F.lit(9.0)
    window = geo.window_of(F.lit(543990.0) + i, F.lit(4188000.0) + j, F.lit(544300.0) + i, F.lit(4188500.0) + j, *fx.ORIGIN, *fx.RES)
    return fx.scenes(spark, d).select("item_id", *(c.alias(n) for n, c in grids.window_transform(window["col_off"], window["row_off"], fx.ORIGIN, fx.RES).items()))


def corners_sql() -> str:
    corners = " UNION ALL ".join(f"SELECT item_id AS id, {x} AS lon, {y} AS lat FROM scene" for x in ("minx", "maxx") for y in ("miny", "maxy"))
    return utm_sql().replace("FROM centre", f"FROM ({corners}) centre").replace("SELECT item_id, sinh", "SELECT id AS item_id, sinh")


@register("aoi_utm_envelope", f"WITH {fx.SCENE_SQL}, {corners_sql()}".replace(" SELECT item_id, floor((500000e0", ", v AS (SELECT item_id, floor((500000e0") + ") SELECT item_id, min(east) AS minx, min(north) AS miny, max(east) AS maxx, max(north) AS maxy FROM v GROUP BY item_id")
def aoi_utm_envelope(spark, d):
    own = fx.scenes(spark, d).select("item_id", geo.box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))).alias("ring"))

    def cut(c):  # to the millimetre
        return F.floor(c * F.lit(1e3) + F.lit(0.5)).cast("double") / F.lit(1e3)

    return own.select("item_id", *(cut(c).alias(n) for n, c in grids.projected_envelope(F.col("ring"), 10).items()))


ASSET_SQL = "asset AS (SELECT * FROM (VALUES ('red', 'B04'), ('green', 'B03'), ('blue', 'B02'), ('nir', 'B08'), ('swir2', 'B12'), ('scl', 'SCL'), ('b05', 'B05'), ('b8a', 'B8A')) t(band, asset))"


@register("band_assets", f"WITH {fx.SCENE_SQL}, {ASSET_SQL} SELECT item_id, band, asset, CASE WHEN asset IN ('B04', 'B08') THEN 'https://data.example.com/' || item_id || '/' || asset || '.tif' END AS href FROM scene CROSS JOIN asset")
def band_assets(spark, d):
    def entry(key):
        return F.lit(key), F.struct(F.concat(F.lit("https://data.example.com/"), F.col("item_id").cast("string"), F.lit(f"/{key}.tif")).alias("href"))

    own = fx.scenes(spark, d).select("item_id", F.create_map(*entry("B04"), *entry("B08")).alias("assets"))
    return grids.band_assets(own)


# ---- end to end ----

def chosen_blocks_sql(inside: str, only: str = "") -> str:
    return (
        f"f AS (SELECT *, month(datetime) AS month FROM scene WHERE {SEARCH.format(cloud=60)}), g0 AS (SELECT *, {MONTHLY.format(keys='month')} FROM f), g AS (SELECT * FROM g0 WHERE r = 1{only}), "
        f"c AS (SELECT item_id, CAST(datetime AS DATE) AS date, row, col, CAST(nullif(b05, 0) AS DOUBLE) AS b05, CAST(nullif(b8a, 0) AS DOUBLE) AS b8a FROM pixel JOIN g USING (grid_id) WHERE {inside}), "
        "z AS (SELECT item_id, min(row) AS r0, min(col) AS c0, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w FROM c GROUP BY item_id), "
        "b AS (SELECT item_id, date, CAST((row - r0) // 2 AS INTEGER) AS br, CAST((col - c0) // 2 AS INTEGER) AS bc, avg(b05) * 1e-4 AS b05, avg(b8a) * 1e-4 AS b8a FROM c JOIN z USING (item_id) WHERE row - r0 < h // 2 * 2 AND col - c0 < w // 2 * 2 GROUP BY ALL) "
    )


SERIES_SQL = "SELECT item_id, date, round(avg((b8a - b05) / nullif(b8a + b05, 0e0)), 6) AS ndvi FROM b GROUP BY item_id, date"
#: The box of AREA in the grids' zone, from its corners.
AREA_SQL = (
    "centre AS (SELECT * FROM (VALUES (0, -122.50e0, 37.75e0), (0, -122.40e0, 37.75e0), (0, -122.50e0, 37.85e0), (0, -122.40e0, 37.85e0)) k(item_id, lon, lat)), "
    + utm_sql().replace(" SELECT item_id, floor((500000e0", ", v AS (SELECT item_id, floor((500000e0")
    + "), env AS (SELECT min(east) AS x0, min(north) AS y0, max(east) AS x1, max(north) AS y1 FROM v)"
)
IN_AREA = "x BETWEEN (SELECT x0 FROM env) AND (SELECT x1 FROM env) AND y BETWEEN (SELECT y0 FROM env) AND (SELECT y1 FROM env)"


def grid_table(spark: SparkSession, d: str) -> DataFrame:
    return grids.measured(fx.pixels(spark, d), GRID, 32610, fx.ORIGIN, fx.RES)


@register("ndvi_time_series", f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL}, {chosen_blocks_sql(IN_BOX)}{SERIES_SQL}")
def ndvi_time_series(spark, d):
    return pipeline.monthly_series(fx.scenes(spark, d), fx.pixels(spark, d), AREA, BOX, *YEAR)


@register("ndvi_time_series_of_area", f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL}, {AREA_SQL}, {chosen_blocks_sql(IN_AREA)}{SERIES_SQL}")
def ndvi_time_series_of_area(spark, d):
    """The area is projected for each scene's grid."""
    return pipeline.monthly_series(fx.scenes(spark, d), fx.pixels(spark, d), AREA, None, *YEAR, grids=grid_table(spark, d))


@register(
    "ndvi_pixels_of_month",
    f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL}, {AREA_SQL}, {chosen_blocks_sql(IN_AREA, ' ORDER BY datetime, item_id LIMIT 1 OFFSET 2')}SELECT item_id, date, br AS brow, bc AS bcol, (b8a - b05) / nullif(b8a + b05, 0e0) AS ndvi FROM b",
)
def ndvi_pixels_of_month(spark, d):
    """The map of the third scene of the series."""
    blocks = pipeline.monthly_blocks(fx.scenes(spark, d), fx.pixels(spark, d), AREA, None, *YEAR, nth=2, grids=grid_table(spark, d))
    return blocks.select("item_id", "date", "brow", "bcol", F.col("red_edge_ndvi").alias("ndvi"))


def single_scene_sql(inside: str, more: str = "") -> str:
    return (
        f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL}, {fx.COARSE_SQL}, {more}one AS (SELECT item_id, grid_id FROM scene WHERE {SEARCH.format(cloud=40)} ORDER BY datetime DESC, item_id LIMIT 1), "
        f"s AS (SELECT item_id, p.row, p.col, red * 1e-4 AS red, green * 1e-4 AS green, blue * 1e-4 AS blue, nir * 1e-4 AS nir, c.swir2 * 1e-4 AS swir2 FROM pixel p JOIN one USING (grid_id) LEFT JOIN coarse c ON c.grid_id = p.grid_id AND c.row = p.row // 2 AND c.col = p.col // 2 WHERE {inside}), "
        "e AS (SELECT min(least(red, green, blue)) AS lo, max(greatest(red, green, blue)) AS hi FROM s) "
        f"SELECT item_id, row, col, {SQL_INDEX['ndvi_safe']} AS ndvi, {SQL_INDEX['nbr_safe']} AS nbr, {SQL_INDEX['ndwi_nir_swir2_safe']} AS ndwi, {', '.join(f'CAST(floor(({b} - lo) / (hi - lo + 1e-6) * 255) AS INTEGER) AS {b}_byte' for b in render.RGB)} FROM s, e"
    )


def single_scene_query(name: str, sql: str, box, by_area: bool) -> None:
    @register(name, sql)
    def run(spark, d):
        px = fx.pixels(spark, d)
        out = pipeline.single_scene(fx.scenes(spark, d), px, AREA, box, *YEAR, coarse=fx.coarse_pixels(px), grids=grid_table(spark, d) if by_area else None)
        return out.select("item_id", "row", "col", F.col("ndvi_safe").alias("ndvi"), F.col("nbr_safe").alias("nbr"), F.col("ndwi_nir_swir2_safe").alias("ndwi"), *(f"{b}_byte" for b in render.RGB))


single_scene_query("single_scene", single_scene_sql(IN_BOX), BOX, False)
single_scene_query("single_scene_of_area", single_scene_sql(IN_AREA, f"{AREA_SQL}, "), None, True)


MASKED = "m AS (SELECT grid_id, row, col, " + ", ".join(f"CASE WHEN {ring_sql()} AND NOT coalesce({ring_sql()} AND scl IN (3, 8, 9, 10, 11), FALSE) THEN CAST(nullif({b}, 0) AS DOUBLE) * 1e-4 END AS {b}" for b in ("red", "green", "blue", "nir", "swir2")) + " FROM pixel WHERE x BETWEEN 544010e0 AND 544600e0 AND y BETWEEN 4188500e0 AND 4189330e0)"


@register("explore_scene", f"WITH {fx.PIXEL_SQL}, {MASKED} SELECT grid_id, row, col, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in PLAIN)} FROM m")
def explore_scene(spark, d):
    return pipeline.explore(fx.pixels(spark, d), RING).select(*CELL, *PLAIN)


@register("explore_scene_resampled", f"WITH {fx.PIXEL_SQL.replace('pixel AS', 'whole AS')}, {fx.COARSE_SQL.replace('FROM pixel', 'FROM whole')}, pixel AS (SELECT p.* REPLACE (c.swir2 AS swir2, c.scl AS scl) FROM whole p LEFT JOIN coarse c ON c.grid_id = p.grid_id AND c.row = p.row // 2 AND c.col = p.col // 2), {MASKED} SELECT grid_id, row, col, {', '.join(f'{SQL_INDEX[n]} AS {n}' for n in PLAIN)} FROM m")
def explore_scene_resampled(spark, d):
    """The short-wave band and the classes come from the 20 m grid."""
    px = fx.pixels(spark, d)
    return pipeline.explore(px, RING, coarse=fx.coarse_pixels(px)).select(*CELL, *PLAIN)


from rasterloom.plans import area_queries, series_queries  # noqa: E402  their queries register themselves here


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


assert set(SQL_INDEX) == set(INDICES) and area_queries and series_queries
