"""End-to-end plans: a single scene, an exploration and the monthly series, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.indices import index
from rasterloom.operators import catalog, raster, render
from rasterloom.operators.areas import clip_to_areas
from rasterloom.operators.grids import clip_to_area

#: Scenes of a series at most, one for a month.
MONTHS = 12


def placed(px: DataFrame, scenes: DataFrame, area, box, grids: DataFrame | None, key: str) -> DataFrame:
    """The pixels of MONTHS scenes at most in the area: projected for each scene's grid where grids (key, epsg) are given,
    else in a box that is projected already and whose bounds reach the scan."""
    if grids is None:
        return raster.clip(px, box).join(F.broadcast(scenes), key)
    return clip_to_area(px, scenes.join(grids.select(key, "epsg").distinct(), key), area, [key], MONTHS)


def single_scene(items: DataFrame, px: DataFrame, area, box, start: str, end: str, item_id=None, coarse: DataFrame | None = None, key: str = "grid_id", max_cloud: float = 40, grids: DataFrame | None = None) -> DataFrame:
    """The newest matching scene (or that with item_id): window clip, 20 m bands brought to 10 m, scaling, colours and safe indices."""
    found = catalog.search(items, area, start, end, max_cloud)
    chosen = catalog.newest(found) if item_id is None else found.filter(F.col("item_id") == item_id)
    cut = placed(px.drop("swir2", "scl") if coarse is not None else px, chosen.select(key, "item_id"), area, box, grids, key)  # one row
    wide = render.rgb_stretch(raster.scale_bands(cut), ["item_id"], suffix="_byte", scenes=1)
    if coarse is not None:
        own = coarse.join(F.broadcast(chosen.select(key)), key, "left_semi")
        wide = raster.resample_nearest(wide, raster.scale_bands(own), [key], ["swir2", "scl"])
    return wide.select("*", index("ndvi_safe"), index("nbr_safe"), index("ndwi_nir_swir2_safe"))


def explore(px: DataFrame, ring, nodata: int = 0, coarse: DataFrame | None = None, keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """Masked read, polygon clip, 20 m bands brought to 10 m, scaling, cloud mask, then the plain indices, in that order."""
    cut = raster.clip(raster.mask_nodata(px if coarse is None else px.drop("swir2", "scl"), nodata), ring=ring, mode="polygon")
    if coarse is not None:
        cut = raster.resample_nearest(cut, raster.mask_nodata(coarse, nodata), list(keys), ["swir2", "scl"])
    ready = raster.mask_clouds(raster.scale_bands(cut))
    return ready.select("*", *(index(n) for n in ("ndvi", "evi", "ndwi_mcfeeters", "nbr")))


def explore_areas(px: DataFrame, given: DataFrame, grids: DataFrame, nodata: int = 0, key: str = "grid_id", scenes: int | None = None) -> DataFrame:
    """As explore, for a table of areas in degrees (key, area_id, rings with holes): each is projected for its grid, and the
    pixels inside come once for each area. scenes: how many spans all areas have at most, if that is known."""
    cut = clip_to_areas(raster.mask_nodata(px, nodata), given, grids, [key], scenes=scenes)
    ready = raster.mask_clouds(raster.scale_bands(cut))
    return ready.select("*", *(index(n) for n in ("ndvi", "evi", "ndwi_mcfeeters", "nbr")))


def monthly_blocks(items: DataFrame, px: DataFrame, area, box, start: str, end: str, max_cloud: float = 60, factor: int = 2, key: str = "grid_id", nth: int | None = None, grids: DataFrame | None = None) -> DataFrame:
    """(item_id, date, brow, bcol, red_edge_ndvi) of each month's least cloudy scene, or of the nth of these by date.

    The scenes are chosen before any pixel is read; there is at most one for a month, so they are broadcast to the pixel
    scan. Blocks are averaged as digital numbers before the ratio.
    """
    chosen = catalog.least_cloudy(catalog.search(items, area, start, end, max_cloud))
    chosen = chosen if nth is None else catalog.nth(chosen, nth)
    return blocks_of(chosen, px, area, box, factor, key, grids, MONTHS)


def blocks_of(chosen: DataFrame, px: DataFrame, area, box, factor: int, key: str, grids: DataFrame | None, scenes: int) -> DataFrame:
    """(item_id, date, brow, bcol, red_edge_ndvi) of some scenes, `scenes` at most."""
    own = chosen.select("item_id", F.to_date("datetime").alias("date"), key)
    cut = placed(raster.mask_nodata(px.select(key, "row", "col", "x", "y", "b05", "b8a")), own, area, box, grids, key)
    blocks = raster.coarsen(cut, ["item_id", "date"], factor, ["b05", "b8a"], coordinates=False, rebase=True, scenes=scenes)
    return raster.scale_bands(blocks).select("item_id", "date", "brow", "bcol", index("red_edge_ndvi"))


def monthly_series(items: DataFrame, px: DataFrame, area, box, start: str, end: str, max_cloud: float = 60, factor: int = 2, key: str = "grid_id", grids: DataFrame | None = None) -> DataFrame:
    """(item_id, date, ndvi): the mean red-edge index of each month's least cloudy scene. Scenes without a pixel in the area
    are absent (see skipped)."""
    ndvi = monthly_blocks(items, px, area, box, start, end, max_cloud, factor, key, grids=grids)
    return ndvi.groupBy("item_id", "date").agg(F.round(F.avg("red_edge_ndvi"), 6).alias("ndvi")).orderBy("date", "item_id")


#: The stored series' schema; a month without a pixel in the area has a null.
STORED = "item_id long, date date, ndvi double, year int, month int"


def refresh_series(spark: SparkSession, path: str, items: DataFrame, new: DataFrame | None, px: DataFrame, area, box, start: str, end: str, max_cloud: float = 60, factor: int = 2, key: str = "grid_id", grids: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """Bring a stored monthly series (one folder for a year and month) up to date: the months that new or removed scenes touch
    are chosen and computed anew from all items there are now, and their folders alone are replaced; without either the whole
    series is written, and months that no scene is left of go. A corrected scene counts as removed in its old form and as new.

    Repeating a refresh changes nothing. A touched month without a scene, or whose chosen scene has no pixel in the area, is
    stored with a null, so that an older value doesn't stay.
    """
    found = catalog.search(items, area, start, end, max_cloud)
    month = {"year": F.year("datetime"), "month": F.month("datetime")}
    changed = [catalog.search(x, area, start, end, max_cloud) for x in (new, removed) if x is not None]
    touched = reduce(DataFrame.union, (x.select(*(c.alias(n) for n, c in month.items())) for x in changed)).distinct() if changed else None
    if changed:
        found = found.withColumns(month).join(F.broadcast(touched), ["year", "month"], "left_semi")  # a row for a month
    chosen = catalog.least_cloudy(found, by_year=True).select("item_id", "datetime", key)
    months = 12 * (int(str(end)[:4]) - int(str(start)[:4]) + 1)
    ndvi = blocks_of(chosen, px, area, box, factor, key, grids, months).groupBy("item_id").agg(F.round(F.avg("red_edge_ndvi"), 6).alias("ndvi"))
    rows = chosen.join(ndvi, "item_id", "left").select("item_id", F.to_date("datetime").alias("date"), "ndvi", *(c.alias(n) for n, c in month.items()))
    if changed:
        rows = touched.join(rows, ["year", "month"], "left").select(*rows.columns)
    mode = "dynamic" if changed else "static"
    rows.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("year", "month").parquet(path)


def stored_series(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, date, ndvi) of a stored series, by date."""
    return spark.read.schema(STORED).parquet(path).filter("ndvi is not null").select("item_id", "date", "ndvi").orderBy("date", "item_id")
