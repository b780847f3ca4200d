"""Products for display, as tables: stretches, composites, histograms, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import as_byte, clipped, safely_divided
from rasterloom.operators.raster import coarsen, extents, few

RGB = ("red", "green", "blue")


def rgb_stretch(px: DataFrame, keys: list[str], bands=RGB, suffix: str = "", scenes: int | None = None) -> DataFrame:
    """8-bit colours in the bands' columns, or in others with a suffix: all three bands of a grid share one minimum and one
    maximum; missing values stay null. scenes: how many grids there are at most, if that is known."""
    low, high = F.min(F.least(*bands)).alias("_low"), F.max(F.greatest(*bands)).alias("_high")
    extent = px.groupBy(*keys).agg(low, high)  # one row for each grid, summed up in the tasks first
    wide = px.join(few(extent, scenes), keys)
    share = {b + suffix: as_byte(safely_divided(F.col(b) - F.col("_low"), F.col("_high") - F.col("_low"))) for b in bands}
    return wide.withColumns(share).drop("_low", "_high")


def true_color(px: DataFrame, low: float = 0.0, high: float = 0.3, bands=RGB) -> DataFrame:
    return px.withColumns({b: clipped(F.col(b), low, high) for b in bands})


def histogram(px: DataFrame, keys: list[str], value: str, bins: int = 50, scenes: int | None = None) -> DataFrame:
    """Counts in equal bins between each grid's least and greatest value; the last bin is closed, empty ones are listed."""
    known = px.filter(F.col(value).isNotNull())
    extent = few(known.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")), scenes)
    step = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    # a flat grid has all its values in the first bin
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_low"), step)), F.lit(0)), F.lit(bins - 1)).cast("int") + 1
    counts = known.join(extent, keys).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = extent.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def cross_section(px: DataFrame, keys: list[str], value: str, scenes: int | None = None, grids: DataFrame | None = None) -> DataFrame:
    """The middle row of each grid, missing values as gaps; order by col to draw it."""
    middle = extents(px, keys, grids=grids).select(*keys, F.floor(F.col("_height") / 2).cast("int").alias("row"))
    return px.join(few(middle, scenes), [*keys, "row"]).select(*keys, "row", "col", value)


def value_range(px: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Least and greatest value of each index, for a colour scale."""
    ends = px.groupBy(*keys).agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)))
    each = (F.struct(F.lit(n).alias("index"), F.col(f"min_{n}").alias("low"), F.col(f"max_{n}").alias("high")) for n in names)
    return ends.select(*keys, F.inline(F.array(*each)))


def colour_scaled(px: DataFrame, names: list[str], low: float = -1.0, high: float = 1.0) -> DataFrame:
    return px.withColumns({n: clipped(F.col(n), low, high) for n in names})


def class_distribution(px: DataFrame, keys: list[str]) -> DataFrame:
    return px.groupBy(*keys, "scl").agg(F.count("*").alias("n"))


def quicklook(px: DataFrame, keys: list[str], bands: list[str], factor: int = 20, scenes: int | None = None, grids: DataFrame | None = None) -> DataFrame:
    return coarsen(px, keys, factor, bands, coordinates=False, scenes=scenes, grids=grids)
