"""Fixed schemas of the engine's tables, checked on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
RING = T.ArrayType(struct(x=DOUBLE, y=DOUBLE))
BOX = {c: DOUBLE for c in ("minx", "miny", "maxx", "maxy")}

ITEMS = struct(item_id=TEXT, collection=TEXT, datetime=T.TimestampNTZType(), cloud_cover=DOUBLE, **BOX, ring=RING, assets=T.MapType(TEXT, struct(href=TEXT)))
GRIDS = struct(scene_id=LONG, band=TEXT, epsg=INT, origin_x=DOUBLE, origin_y=DOUBLE, res_x=DOUBLE, res_y=DOUBLE, height=INT, width=INT, nodata=INT)
PIXELS = struct(scene_id=LONG, row=INT, col=INT, x=DOUBLE, y=DOUBLE, **{b: INT for b in ("red", "green", "blue", "nir", "swir1", "swir2", "b05", "b8a", "scl")})
SERIES = struct(date=T.DateType(), ndvi=DOUBLE)

REFLECTANCE_BANDS = ("red", "green", "blue", "nir", "swir1", "swir2", "b05", "b8a")
#: Logical bands and the product's asset keys.
BAND_ASSETS = {"red": "B04", "green": "B03", "blue": "B02", "nir": "B08", "swir2": "B12", "scl": "SCL", "b05": "B05", "b8a": "B8A"}
#: Scene classes that count as cloud shadow, medium and high cloud, cirrus, snow or ice.
CLOUD_CLASSES = (3, 8, 9, 10, 11)
REFLECTANCE_SCALE, NODATA, EPSILON = 0.0001, 0, 1e-6


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself, or ValueError naming the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
