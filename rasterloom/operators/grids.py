"""Grid metadata: reference systems, origins and windows, kept beside the pixels in a small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.geometry import area_rings, envelope, pixel_centre, to_utm
from rasterloom.operators.raster import few
from rasterloom.schemas import BAND_ASSETS
from rasterloom.sources.tables import FOLDER, folder_side


def measured(px: DataFrame, keys: list[str], epsg: int, origin: tuple[float, float], res: tuple[float, float]) -> DataFrame:
    """A grids table for pixel tables that share an origin: one row for each grid with its height and width."""
    size = px.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    fixed = {"epsg": epsg, "origin_x": origin[0], "origin_y": origin[1], "res_x": res[0], "res_y": res[1]}
    return size.withColumns({k: F.lit(v) for k, v in fixed.items()})


def referenced(px: DataFrame, grids: DataFrame, keys: list[str], scenes: int | None = None) -> DataFrame:
    """Pixels with their grid's reference system and their centres' coordinates."""
    wide = px.drop("x", "y").join(few(grids.select(*keys, "epsg", "origin_x", "origin_y", "res_x", "res_y"), scenes), keys)
    x, y = pixel_centre(F.col("col"), F.col("origin_x"), F.col("res_x")), pixel_centre(F.col("row"), F.col("origin_y"), F.col("res_y"))
    return wide.withColumns({"x": x, "y": y}).drop("origin_x", "origin_y", "res_x", "res_y")


def reference_of(grids: DataFrame, key: str, scene) -> DataFrame:
    """The reference system of one scene."""
    return grids.filter(F.col(key) == scene).select(key, "epsg").distinct()


def window_transform(col_off: Column, row_off: Column, origin: tuple[float, float], res: tuple[float, float]) -> dict[str, Column]:
    """a, c, e, f of a window's own transform: the grid's steps, and the window's upper left corner."""
    return {"a": F.lit(res[0]), "c": F.lit(origin[0]) + col_off * F.lit(res[0]), "e": F.lit(res[1]), "f": F.lit(origin[1]) + row_off * F.lit(res[1])}


def utm_of(epsg: Column) -> tuple[Column, Column]:
    """The zone and whether it is a southern one, of a WGS 84 grid's code (326 or 327 and the zone)."""
    return epsg % 100, F.floor(epsg / 100) == 327


def projected_envelope(ring: Column, zone: int | Column, south: Column | None = None) -> dict[str, Column]:
    """The box around a ring of longitudes and latitudes once its vertices are projected; larger than the ring itself."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)

    def moved(p: Column) -> Column:
        east, north = to_utm(p.x, p.y, zone, south)
        return F.struct(east.alias("x"), north.alias("y"))

    return envelope(F.transform(ring, moved))


#: What a table of grids must have, beside its keys, to tell a window's tiles.
PLACE = ("epsg", "origin_x", "origin_y", "res_x", "res_y", "height", "width")


def wanted_folders(placed: DataFrame, side: int, names: tuple[str, str] = FOLDER) -> DataFrame:
    """placed (PLACE, _minx, _miny, _maxx, _maxy) once for each folder of side x side pixels that its box touches (names)."""

    def ends(low: str, high: str, origin: str, step: str, size: str) -> tuple[Column, Column]:
        a, b = ((F.col(c) - F.col(origin)) / F.col(step) for c in (low, high))
        return F.greatest(F.floor(F.least(a, b)), F.lit(0)).cast("int"), F.least(F.floor(F.greatest(a, b)), F.col(size) - 1).cast("int")

    (top, bottom), (left, right) = ends("_miny", "_maxy", "origin_y", "res_y", "height"), ends("_minx", "_maxx", "origin_x", "res_x", "width")
    some = placed.withColumns({"_top": top, "_bottom": bottom, "_left": left, "_right": right}).filter("_top <= _bottom and _left <= _right")
    for name, low, high in zip(names, ("_top", "_left"), ("_bottom", "_right"), strict=True):
        some = some.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / side).cast("int"), F.floor(F.col(high) / side).cast("int"))))
    return some.drop("_top", "_bottom", "_left", "_right")


def clip_to_area(px: DataFrame, scenes: DataFrame, area, keys: list[str], most: int | None = None, tile: int | None = None) -> DataFrame:
    """The pixels of scenes (keys, epsg and more columns) in an area given in degrees, projected for each scene's own
    reference system, beside the scenes' columns. most: how many scenes there are at most, if that is known.

    tile: the size of the stored tiles (see write_pixels), where px has them and scenes have PLACE: then only the folders of
    the tiles that the area touches are opened, and nothing of other scenes. Tables stored with a folder for each tile of any
    size (tile_row, tile_col) are read as well.
    """
    rings = F.array(*(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)) for ring in area_rings(area)))
    box = projected_envelope(F.flatten(rings), *utm_of(F.col("epsg")))
    placed = scenes.withColumns({f"_{k}": v for k, v in box.items()})
    inside = F.col("x").between(F.col("_minx"), F.col("_maxx")) & F.col("y").between(F.col("_miny"), F.col("_maxy"))
    wanted, names = placed, ()
    if tile is not None:
        side, names = (folder_side(tile), FOLDER) if FOLDER[0] in px.columns else (tile, ("tile_row", "tile_col"))
        wanted = wanted_folders(placed, side, names).drop(*PLACE[1:])
    return px.join(few(wanted, most), [*keys, *names]).filter(inside).drop("_minx", "_miny", "_maxx", "_maxy")


def band_assets(items: DataFrame, bands=tuple(BAND_ASSETS)) -> DataFrame:
    """One row for each item and band: the band, its asset key and the asset's address (null if the item lacks it)."""
    pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(BAND_ASSETS[b]).alias("asset")) for b in bands))
    each = items.withColumn("_pair", F.explode(pairs))
    return each.select(*items.columns, "_pair.band", "_pair.asset", F.try_element_at("assets", F.col("_pair.asset")).href.alias("href")).drop("assets")


def with_bands(px: DataFrame, bands: list[str]) -> DataFrame:
    """px with a null column for each optional band that it lacks."""
    return reduce(lambda df, b: df if b in df.columns else df.withColumn(b, F.lit(None).cast("int")), bands, px)
