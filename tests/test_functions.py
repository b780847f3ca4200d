from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import scalar
from rasterloom.functions.indices import CLASSES, INDICES, index, index_class


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_division(spark):
    got = one(spark, a=scalar.divided(F.lit(1.0), F.lit(0.0)), b=scalar.safely_divided(F.lit(0.0), F.lit(0.0)), c=scalar.safely_divided(F.lit(1.0), F.lit(-1e-6)))
    assert (got.a, got.b, got.c) == (None, 0.0, None)


def test_clip_keeps_null(spark):
    got = one(spark, a=scalar.clipped(F.lit(None).cast("double"), 0.0, 0.3), b=scalar.clipped(F.lit(0.7), 0.0, 0.3), c=scalar.clipped(F.lit(-1.0), 0.0, 0.3))
    assert (got.a, got.b, got.c) == (None, 0.3, 0.0)


@pytest.mark.parametrize("scl", [None, *range(12)])
def test_cloud_mask(spark, scl):
    got = one(spark, a=scalar.cloud_masked(F.lit(7), F.lit(scl).cast("int")))
    assert got.a == (None if scl in (3, 8, 9, 10, 11) else 7)


def test_bytes_truncate(spark):
    assert one(spark, a=scalar.as_byte(F.lit(254.99 / 255))).a == 254


def test_label(spark):
    when = F.lit("2023-06-01 10:00:00").cast("timestamp_ntz")
    got = one(spark, a=scalar.scene_label(F.lit("S2"), when, F.lit(None).cast("double")), b=scalar.scene_label(F.lit("S2"), when, F.lit(3.5)))
    assert got.a == "S2 — 2023-06-01 — Cloud N/A%" and got.b == "S2 — 2023-06-01 — Cloud 3.5%"


def test_first_tile(spark):
    got = one(spark, a=scalar.first_tile(F.lit('{"tiles":["x","y"]}')), b=scalar.first_tile(F.lit('{"tiles":[]}')), c=scalar.first_tile(F.lit("{}")))
    assert (got.a, got.b, got.c) == ("x", None, None)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1))
def test_normalised_differences_are_bounded(spark, red, green, blue, nir, swir1, swir2, b05):
    df = spark.range(1).select(*(F.lit(v).alias(n) for n, v in dict(red=red, green=green, blue=blue, nir=nir, swir1=swir1, swir2=swir2, b05=b05, b8a=nir).items()))
    got = df.select(*(index(n) for n in INDICES)).first()
    for n in INDICES:
        if n not in ("evi", "savi", "bai") and got[n] is not None:
            assert -1 - 1e-9 <= got[n] <= 1 + 1e-9
    if nir + red > 0:
        assert math.isclose(got.ndvi, (nir - red) / (nir + red), rel_tol=1e-12, abs_tol=1e-12)
    else:
        assert got.ndvi is None


def test_classes_are_half_open(spark):
    got = one(spark, a=index_class("ndvi", F.lit(0.2)), b=index_class("ndvi", F.lit(0.8)), c=index_class("ndvi", F.lit(None).cast("double")), d=index_class("ndvi", F.lit(-0.5)))
    assert (got.a, got.b, got.c, got.d) == ("grass/shrubs", None, None, "water/shadow")
    assert set(CLASSES) <= set(INDICES)


VERTICES = [
    (-122.5, 37.75, 544047.4126, 4178195.2567),
    (-122.5, 37.85, 543988.0685, 4189290.1927),
    (-122.4, 37.75, 552856.9698, 4178247.0309),
    (-122.4, 37.85, 552785.7558, 4189342.0136),
]


@pytest.mark.parametrize(("lon", "lat", "east", "north"), VERTICES)
def test_projection(spark, lon, lat, east, north):
    x, y = geo.to_utm(F.lit(lon), F.lit(lat), F.lit(10))
    got = one(spark, x=x, y=y, zone=geo.utm_zone(F.lit(lon)))
    assert abs(got.x - east) < 1e-3 and abs(got.y - north) < 1e-3 and got.zone == 10


def test_box_around(spark):
    got = one(spark, **geo.box_around(F.lit(37.7749), F.lit(-122.4194), F.lit(10.0), F.lit(10.0)))
    assert all(abs(a - b) < 1e-8 for a, b in zip(got, (-122.47638850, 37.72985495, -122.36241150, 37.81994505), strict=True))


def test_guards():
    with pytest.raises(ValueError):
        geo.check_dates("2023-02-01", "2023-01-01")
    geo.check_dates("2023-01-01", "2023-01-01")
    with pytest.raises(ValueError):
        geo.check_size(0.5, 10)
    with pytest.raises(ValueError):
        geo.area_box(None)
    assert geo.area_box({"coordinates": [[[1, 2], [3, 2], [3, 5], [1, 5], [1, 2]]]}) == (1, 2, 3, 5)
    assert scalar.date_range(dt.date(2023, 1, 1), dt.date(2023, 2, 1)) == "2023-01-01/2023-02-01"


def test_ring(spark):
    ring = [(0.0, 0.0), (4.0, 1.0), (5.0, 5.0), (1.0, 4.0)]
    grid = spark.range(36).select((F.col("id") % 6 + 0.5).alias("x"), (F.floor(F.col("id") / 6) + 0.5).alias("y"))

    def inside(x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    for r in grid.select("x", "y", geo.in_ring(F.col("x"), F.col("y"), ring).alias("i")).collect():
        assert r.i == inside(r.x, r.y)
