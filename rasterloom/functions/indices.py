"""Spectral indices: name -> the bands that it needs, and its expression over scaled bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.scalar import divided, safely_divided


def normalised(a: str, b: str, divide=divided) -> Callable[[], Column]:
    return lambda: divide(F.col(a) - F.col(b), F.col(a) + F.col(b))


def evi() -> Column:
    return divided(F.lit(2.5) * (F.col("nir") - F.col("red")), F.col("nir") + F.lit(6.0) * F.col("red") - F.lit(7.5) * F.col("blue") + F.lit(1.0))


def savi() -> Column:
    return divided(F.lit(1.5) * (F.col("nir") - F.col("red")), F.col("nir") + F.col("red") + F.lit(0.5))


def bai() -> Column:
    r, n = F.lit(0.1) - F.col("red"), F.lit(0.06) - F.col("nir")
    return divided(F.lit(1.0), r * r + n * n)


INDICES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "ndvi": (("nir", "red"), normalised("nir", "red")),
    "evi": (("nir", "red", "blue"), evi),
    "ndwi_mcfeeters": (("green", "nir"), normalised("green", "nir")),
    "nbr": (("nir", "swir2"), normalised("nir", "swir2")),
    "red_edge_ndvi": (("b8a", "b05"), normalised("b8a", "b05")),
    "savi": (("nir", "red"), savi),
    "ndre": (("nir", "b05"), normalised("nir", "b05")),
    "mndwi": (("green", "swir1"), normalised("green", "swir1")),
    "ndmi": (("nir", "swir1"), normalised("nir", "swir1")),
    "nbr2": (("swir1", "swir2"), normalised("swir1", "swir2")),
    "bai": (("red", "nir"), bai),
    "ndbi": (("swir1", "nir"), normalised("swir1", "nir")),
    "ndvi_safe": (("nir", "red"), normalised("nir", "red", safely_divided)),
    "nbr_safe": (("nir", "swir2"), normalised("nir", "swir2", safely_divided)),
    "ndwi_nir_swir2_safe": (("nir", "swir2"), normalised("nir", "swir2", safely_divided)),
}

#: The class bounds of the published table, half-open from below; what lies outside has no class.
CLASSES: dict[str, tuple[tuple[float | None, float | None, str], ...]] = {
    "ndvi": ((None, 0.0, "water/shadow"), (0.0, 0.2, "soil/urban"), (0.2, 0.5, "grass/shrubs"), (0.5, 0.8, "healthy vegetation")),
    "evi": ((None, 0.0, "water"), (0.0, 0.2, "soil"), (0.2, 0.5, "moderate vegetation"), (0.5, 0.9, "dense vegetation")),
    "savi": ((None, 0.1, "soil"), (0.1, 0.3, "sparse vegetation"), (0.3, 0.6, "moderate vegetation"), (0.6, None, "dense vegetation")),
    "ndre": ((None, 0.1, "soil"), (0.1, 0.3, "stressed vegetation"), (0.3, 0.6, "healthy vegetation"), (0.6, None, "high chlorophyll")),
    "ndwi_mcfeeters": ((None, 0.0, "vegetation/urban"), (0.0, 0.3, "wet soil"), (0.3, None, "water")),
    "mndwi": ((None, 0.0, "urban/soil"), (0.3, None, "water")),
    "ndmi": ((None, 0.0, "very dry"), (0.0, 0.1, "dry vegetation"), (0.1, 0.3, "moderate moisture"), (0.3, None, "moist vegetation")),
    "nbr": ((None, -0.1, "severe burn"), (-0.1, 0.0, "burned"), (0.0, 0.1, "stressed vegetation"), (0.1, None, "healthy vegetation")),
    "nbr2": ((None, -0.1, "extreme burn"), (-0.1, 0.0, "severe burn"), (0.0, 0.1, "moderate disturbance"), (0.1, None, "unburned")),
    "ndbi": ((None, 0.0, "vegetation/water"), (0.0, 0.1, "mixed pixels"), (0.1, None, "built-up")),
}


def index(name: str) -> Column:
    return INDICES[name][1]().alias(name)


def index_class(name: str, value: Column | None = None) -> Column:
    """The class of an index value by the table above, null where it has none."""
    v = F.col(name) if value is None else value
    out = F.lit(None).cast("string")
    for low, high, label in CLASSES[name]:
        inside = F.lit(True) if low is None else v >= low
        inside = inside if high is None else inside & (v < high)
        out = F.when(v.isNotNull() & inside, label).otherwise(out)
    return out
