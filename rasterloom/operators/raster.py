"""Pixel tables: one row for a pixel, one nullable column for a band. Grids are told apart by key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.geometry import in_ring, pixel_centre
from rasterloom.functions.scalar import cloud_masked, scaled, without_nodata
from rasterloom.schemas import CLOUD_CLASSES, NODATA, REFLECTANCE_BANDS, REFLECTANCE_SCALE


def bands_of(px: DataFrame, names=REFLECTANCE_BANDS) -> list[str]:
    return [b for b in names if b in px.columns]


def scale_bands(px: DataFrame, scale: float = REFLECTANCE_SCALE, include_scl: bool = False) -> DataFrame:
    """Digital numbers to reflectance; the class band only on request."""
    names = [*bands_of(px), *(["scl"] if include_scl and "scl" in px.columns else [])]
    return px.withColumns({b: scaled(F.col(b), scale) for b in names})


def mask_nodata(px: DataFrame, nodata: int = NODATA) -> DataFrame:
    return px.withColumns({b: without_nodata(F.col(b), nodata) for b in bands_of(px)})


def mask_clouds(px: DataFrame, classes=CLOUD_CLASSES) -> DataFrame:
    """Bands are null under cloud; the class band stays, and pixels of unknown class are kept."""
    return px.withColumns({b: cloud_masked(F.col(b), F.col("scl"), classes) for b in bands_of(px)})


def clip(px: DataFrame, box=None, ring=None, mode: str = "box") -> DataFrame:
    """mode "window" and "box": pixels whose centre lies in a box. "polygon": those in the ring's box, with all bands null
    outside the ring. Literal bounds over x and y reach the scan."""
    if mode in ("window", "box"):
        minx, miny, maxx, maxy = box
        return px.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))
    if mode == "polygon":
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        cut = clip(px, (min(xs), min(ys), max(xs), max(ys)))
        inside = in_ring(F.col("x"), F.col("y"), ring)
        return cut.withColumns({b: F.when(inside, F.col(b)) for b in [*bands_of(cut), *(["scl"] if "scl" in cut.columns else [])]})
    raise ValueError(f"no such clip: {mode}")


#: Rows of a small table of grids that may be broadcast (some 60 bytes each).
BROADCAST_GRIDS = 500_000


def few(grids: DataFrame, scenes: int | None = None) -> DataFrame:
    """A table with a row for each grid, to be joined with its pixels. Where the caller bounds the number of grids it is
    broadcast, and pixels stay where they are; else the choice is left to adaptive execution. Nothing is run or kept here."""
    return F.broadcast(grids) if scenes is not None and scenes <= BROADCAST_GRIDS else grids


def extents(px: DataFrame, keys: list[str], rebase: bool = False, grids: DataFrame | None = None) -> DataFrame:
    """_top, _left, _height and _width of each grid: from a table of grids (height, width), or else from the pixels given,
    which start at 0 (rebase: at the first ones there)."""
    if grids is not None and not rebase:
        return grids.select(*keys, F.lit(0).alias("_top"), F.lit(0).alias("_left"), F.col("height").alias("_height"), F.col("width").alias("_width"))
    top, left = (F.min("row"), F.min("col")) if rebase else (F.lit(0), F.lit(0))
    return px.groupBy(*keys).agg(top.alias("_top"), left.alias("_left"), (F.max("row") - top + 1).alias("_height"), (F.max("col") - left + 1).alias("_width"))


def coarsen(px: DataFrame, keys: list[str], factor: int, bands: list[str], coordinates: bool = True, rebase: bool = False, scenes: int | None = None, grids: DataFrame | None = None) -> DataFrame:
    """Means of blocks of factor x factor pixels, nulls skipped. Blocks that the grid's last rows and columns don't fill are
    left out; height and width are those of the table of grids, else of the pixels given. scenes: how many grids there are at
    most, if that is known."""
    grid = extents(px, keys, rebase, grids)
    row, col = F.col("row") - F.col("_top"), F.col("col") - F.col("_left")
    full = px.join(few(grid, scenes), keys).filter((row < F.floor(F.col("_height") / factor) * factor) & (col < F.floor(F.col("_width") / factor) * factor))
    means = [*bands, *(["x", "y"] if coordinates else [])]
    block = [F.floor(row / factor).cast("int").alias("brow"), F.floor(col / factor).cast("int").alias("bcol")]
    return full.groupBy(*keys, *block).agg(*(F.avg(b).alias(b) for b in means))


def overviews(px: DataFrame, keys: list[str], factors: tuple[int, ...], bands: list[str], scenes: int | None = None, grids: DataFrame | None = None) -> DataFrame:
    """The means of coarsen for a ladder of factors, each a multiple of the one before, in a column `factor`.

    Pixels are read once: they are summed up to (sum, count) states of the first factor's blocks, and these, a small part of
    the pixels, go up the ladder together. Blocks that a grid doesn't fill are left out for each factor by itself.
    """
    if any(b % a for a, b in zip(factors, factors[1:])) or not factors:
        raise ValueError("each factor must be a multiple of the one before")
    first = factors[0]
    part = [F.floor(F.col(c) / first).cast("int").alias(c) for c in ("row", "col")]
    states = [s for b in bands for s in (F.sum(F.col(b).cast("double")).alias(f"_sum_{b}"), F.count(b).alias(f"_n_{b}"))]
    blocks = px.groupBy(*keys, *part).agg(*states).join(few(extents(px, keys, grids=grids), scenes), keys)
    steps = [F.struct(F.lit(f).alias("factor"), F.floor(F.col("row") / (f // first)).cast("int").alias("brow"), F.floor(F.col("col") / (f // first)).cast("int").alias("bcol")) for f in factors]
    held = [c for b in bands for c in (f"_sum_{b}", f"_n_{b}")]
    wide = blocks.select(*keys, "_height", "_width", *held, F.inline(F.array(*steps)))
    full = wide.filter((F.col("brow") < F.floor(F.col("_height") / F.col("factor"))) & (F.col("bcol") < F.floor(F.col("_width") / F.col("factor"))))
    return full.groupBy(*keys, "factor", "brow", "bcol").agg(*(F.try_divide(F.sum(f"_sum_{b}"), F.sum(f"_n_{b}")).alias(b) for b in bands))


def resample_nearest(fine: DataFrame, coarse: DataFrame, keys: list[str], bands: list[str], factor: int = 2) -> DataFrame:
    """fine with the coarse grid's bands: each coarse cell covers factor x factor fine ones; null where there is none."""
    cell = {f"_{c}": F.floor(F.col(c) / factor).cast("int") for c in ("row", "col")}
    found = coarse.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    return fine.withColumns(cell).join(found, [*keys, "_row", "_col"], "left").drop("_row", "_col")


def resample_by_position(target: DataFrame, source: DataFrame, keys: list[str], bands: list[str], origin: tuple[float, float], res: tuple[float, float]) -> DataFrame:
    """Nearest neighbours where the grids aren't aligned: each target centre looks up the source cell that it falls into."""
    cell = {"_col": F.floor((F.col("x") - origin[0]) / res[0]).cast("int"), "_row": F.floor((F.col("y") - origin[1]) / res[1]).cast("int")}
    found = source.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    return target.withColumns(cell).join(found, [*keys, "_row", "_col"], "left").drop("_row", "_col")


def with_coordinates(px: DataFrame, origin: tuple[float, float], res: tuple[float, float]) -> DataFrame:
    return px.withColumns({"x": pixel_centre(F.col("col"), origin[0], res[0]), "y": pixel_centre(F.col("row"), origin[1], res[1])})


def aligned(bands: list[DataFrame], keys: list[str], how: str = "full_outer") -> DataFrame:
    """Band tables (keys and one value each) side by side: "full_outer" keeps all pixels, "inner" those that all have."""
    return reduce(lambda a, b: a.join(b, keys, how), bands)


def stacked(px: DataFrame, keys: list[str], bands: list[str], long: bool = True) -> DataFrame:
    """Bands below each other as (band, value) rows, or as one array in the given order."""
    if long:
        return px.unpivot([F.col(k) for k in keys], [F.col(b) for b in bands], "band", "value")
    return px.select(*keys, F.array(*bands).alias("values"))
