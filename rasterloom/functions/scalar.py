"""Null-safe scalar expressions. A missing value is null, never NaN; a division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.schemas import CLOUD_CLASSES, EPSILON, REFLECTANCE_SCALE


def scaled(band: Column, scale: float = REFLECTANCE_SCALE) -> Column:
    return band.cast("double") * F.lit(scale)


def divided(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def safely_divided(a: Column, b: Column, eps: float = EPSILON) -> Column:
    """eps is added to the denominator, so 0/0 is 0."""
    return F.try_divide(a, b + F.lit(eps))


def clipped(value: Column, low: float, high: float) -> Column:
    """Bounded; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def without_nodata(band: Column, nodata: int = 0) -> Column:
    return F.nullif(band, F.lit(nodata))


def is_cloud(scl: Column, classes=CLOUD_CLASSES) -> Column:
    """An unknown class isn't cloud."""
    return F.coalesce(scl.isin(*classes), F.lit(False))


def cloud_masked(band: Column, scl: Column, classes=CLOUD_CLASSES) -> Column:
    """The pixel stays, its value becomes null under cloud."""
    return F.when(~is_cloud(scl, classes), band)


def as_byte(share: Column) -> Column:
    """0..1 to 0..255, truncated."""
    return F.floor(share * 255).cast("int")


def scene_label(scene_id: Column, when: Column, cloud: Column) -> Column:
    """id — date — Cloud n%; an unknown cover is N/A."""
    return F.concat(scene_id.cast("string"), F.lit(" — "), F.to_date(when).cast("string"), F.lit(" — Cloud "), F.coalesce(cloud.cast("string"), F.lit("N/A")), F.lit("%"))


def date_range(start: str, end: str) -> str:
    return f"{start}/{end}"


def first_tile(body: Column) -> Column:
    """The first tile template of a TileJSON document; null if there is none."""
    return F.get(F.from_json(body, "tiles array<string>").tiles, F.lit(0))


def asset_href(assets: Column, key: str) -> Column:
    return F.try_element_at(assets, F.lit(key)).href
