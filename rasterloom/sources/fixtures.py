"""Scenes and pixels viewed in the star-schema test tables by integer arithmetic.

`orders` gives a scene catalogue and `lineitem` eight pixel grids of 64 columns that scenes share by grid_id; the ragged last row
of each grid exercises trimming. Nothing here belongs to the engine: it only lends its operators something to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN, RES, WIDTH = (543990.0, 4189340.0), (10.0, -10.0), 64
#: Grids that the pixels are dealt to; scenes share them.
GRIDS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cx = F.lit(-122.45) + ((cust % 41) - 20) * F.lit(0.02)
    cy = F.lit(37.80) + ((cust % 37) - 18) * F.lit(0.02)
    cloud = F.when(key % 53 == 0, None).otherwise(((key * 37) % 1001).cast("double") / F.lit(10.0))
    base = o.select(
        key.alias("item_id"),
        (key % GRIDS).alias("grid_id"),
        F.when(key % 10 == 0, "landsat-c2-l2").otherwise("sentinel-2-l2a").alias("collection"),
        F.col("o_orderdate").alias("datetime"),
        cloud.alias("cloud_cover"),
        cx.alias("cx"),
        cy.alias("cy"),
    )
    half = F.lit(0.05)
    return base.select("item_id", "grid_id", "collection", "datetime", "cloud_cover", (F.col("cx") - half).alias("minx"), (F.col("cy") - half).alias("miny"), (F.col("cx") + half).alias("maxx"), (F.col("cy") + half).alias("maxy"))


SCENE_SQL = """base AS (
  SELECT o_orderkey AS item_id, o_orderkey % 8 AS grid_id, CASE WHEN o_orderkey % 10 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection,
    o_orderdate AS datetime, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 10e0 END AS cloud_cover,
    -122.45e0 + ((o_custkey % 41) - 20) * 2e-2 AS cx, 37.80e0 + ((o_custkey % 37) - 18) * 2e-2 AS cy FROM orders),
scene AS (SELECT item_id, grid_id, collection, datetime, cloud_cover, cx - 5e-2 AS minx, cy - 5e-2 AS miny, cx + 5e-2 AS maxx, cy + 5e-2 AS maxy FROM base)"""


def footprints(own: DataFrame) -> DataFrame:
    """Scenes with a footprint that fills half of their box, a diamond, and with two assets."""
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    r = F.lit(0.047)
    ring = [F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y - r), (x + r, y), (x, y + r), (x - r, y), (x, y - r))]

    def entry(key):
        return F.lit(key), F.struct(F.concat(F.lit("https://data.example.com/"), F.col("item_id").cast("string"), F.lit(f"/{key}.tif")).alias("href"))

    return own.withColumns({"ring": F.array(*ring), "assets": F.create_map(*entry("B04"), *entry("rendered_preview"))})


FOOTPRINT = "greatest(-122.50e0 - cx, cx + 122.40e0, 0e0) + greatest(37.75e0 - cy, cy - 37.85e0, 0e0) <= 4.7e-2"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    order = Window.partitionBy("grid_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = li.withColumn("grid_id", s % GRIDS).withColumn("rn", F.row_number().over(order) - 1)  # a filter by grid goes below

    def band(value) -> F.Column:
        return value.cast("int")

    grid = numbered.select(
        "grid_id",
        F.floor(F.col("rn") / WIDTH).cast("int").alias("row"),
        (F.col("rn") % WIDTH).cast("int").alias("col"),
        band((p * 13 + o * 7) % 4000).alias("red"),
        band((o * 17 + p * 3) % 3500).alias("green"),
        band((o * 11 + p * 5) % 3000).alias("blue"),
        band((o * 29 + s * 101) % 6000).alias("nir"),
        band((p * 31 + s * 7) % 4500).alias("swir1"),
        band((s * 37 + o * 19) % 5000).alias("swir2"),
        band((p * 23 + o * 3) % 4200).alias("b05"),
        band((o * 41 + p * 2) % 5800).alias("b8a"),
        F.when(o % 97 == 0, None).otherwise((o + n) % 12).cast("int").alias("scl"),
    )
    x, y = F.lit(ORIGIN[0]) + (F.col("col") + F.lit(0.5)) * F.lit(RES[0]), F.lit(ORIGIN[1]) + (F.col("row") + F.lit(0.5)) * F.lit(RES[1])
    return grid.withColumns({"x": x, "y": y})


PIXEL_SQL = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM lineitem),
grid AS (
  SELECT l_suppkey % 8 AS grid_id, CAST(rn // 64 AS INTEGER) AS row, CAST(rn % 64 AS INTEGER) AS col,
    CAST((l_partkey * 13 + l_orderkey * 7) % 4000 AS INTEGER) AS red, CAST((l_orderkey * 17 + l_partkey * 3) % 3500 AS INTEGER) AS green,
    CAST((l_orderkey * 11 + l_partkey * 5) % 3000 AS INTEGER) AS blue, CAST((l_orderkey * 29 + l_suppkey * 101) % 6000 AS INTEGER) AS nir,
    CAST((l_partkey * 31 + l_suppkey * 7) % 4500 AS INTEGER) AS swir1, CAST((l_suppkey * 37 + l_orderkey * 19) % 5000 AS INTEGER) AS swir2,
    CAST((l_partkey * 23 + l_orderkey * 3) % 4200 AS INTEGER) AS b05, CAST((l_orderkey * 41 + l_partkey * 2) % 5800 AS INTEGER) AS b8a,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST((l_orderkey + l_linenumber) % 12 AS INTEGER) END AS scl FROM numbered),
pixel AS (SELECT *, 543990e0 + (col + 5e-1) * 10e0 AS x, 4189340e0 + (row + 5e-1) * -10e0 AS y FROM grid)"""


def coarse_pixels(px: DataFrame, bands=("swir2", "scl")) -> DataFrame:
    """The 20 m grid: of each block of 2 x 2 pixels the upper left one's values."""
    even = px.filter((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0))
    return even.select("grid_id", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"), *bands)


COARSE_SQL = "coarse AS (SELECT grid_id, row // 2 AS row, col // 2 AS col, swir2, scl FROM pixel WHERE row % 2 = 0 AND col % 2 = 0)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("name"), (key * 7 % 140 - 70).cast("double").alias("lat"), (key * 29 % 340 - 170).cast("double").alias("lon"), F.concat(F.col("n_name"), F.lit(", region "), F.col("n_regionkey").cast("string")).alias("address"))


PLACE_SQL = """place AS (SELECT n_name AS name, CAST(n_nationkey * 7 % 140 - 70 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 340 - 170 AS DOUBLE) AS lon,
  n_name || ', region ' || CAST(n_regionkey AS VARCHAR) AS address FROM nation)"""


def tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    url = F.concat(F.lit("https://tiles.example.com/"), F.get_json_object("props", "$.k"), F.lit("/{z}/{x}/{y}.png"))
    return e.select("event_id", F.concat(F.lit('{"tilejson":"2.2.0","tiles":["'), url, F.lit('"]}')).alias("body"))


TILE_SQL = """tile AS (SELECT event_id, '{"tilejson":"2.2.0","tiles":["https://tiles.example.com/' || json_extract_string(props, '$.k') || '/{z}/{x}/{y}.png"]}' AS body FROM events)"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, and squares with a square hole, of some sizes around the scenes: area_id and rings."""
    key = F.col("n_nationkey")
    cx, cy = F.lit(-122.45) + (key * 7 % 41 - 20) * F.lit(0.02), F.lit(37.80) + (key * 11 % 37 - 18) * F.lit(0.02)
    return shapes(read(spark, sf_dir, "nation"), key, cx, cy, F.lit(0.03) + (key % 5) * F.lit(0.04)).select("area_id", "rings")


def grid_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such shapes over the pixel grids, some for each: grid_id, area_id and rings, in degrees."""
    key = F.col("n_nationkey")
    cx, cy = F.lit(-122.4964) + (key % 3) * F.lit(0.001), F.lit(37.8495) - (key % 7) * F.lit(0.0004)
    own = shapes(read(spark, sf_dir, "nation"), key, cx, cy, F.lit(0.0008) + (key % 5) * F.lit(0.0006))
    return own.select((F.col("area_id") % GRIDS).cast("long").alias("grid_id"), "area_id", "rings")


def shapes(rows: DataFrame, key, cx, cy, r) -> DataFrame:
    def ring(*points):
        return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in (*points, points[0])))

    def square(h):
        return ring((F.col("cx") - h, F.col("cy") - h), (F.col("cx") + h, F.col("cy") - h), (F.col("cx") + h, F.col("cy") + h), (F.col("cx") - h, F.col("cy") + h))

    given = rows.select(key.alias("area_id"), cx.alias("cx"), cy.alias("cy"), r.alias("r"))
    x, y, half = F.col("cx"), F.col("cy"), F.col("r")
    triangle = ring((x - half, y - half), (x + half, y - half), (x, y + half))
    return given.withColumn("rings", F.when(F.col("area_id") % 2 == 1, F.array(triangle)).otherwise(F.array(square(half), square(half * F.lit(0.6)))))


def shape_sql(name: str, cx: str, cy: str, r: str) -> str:
    """CTEs: the shapes' closed rings, and their edges {name}_edge (area_id, ring, i, x1, y1, x2, y2)."""

    def ring(*points: tuple[str, str]) -> str:
        return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in (*points, points[0])) + "]"

    def square(h: str) -> str:
        return ring((f"cx - {h}", f"cy - {h}"), (f"cx + {h}", f"cy - {h}"), (f"cx + {h}", f"cy + {h}"), (f"cx - {h}", f"cy + {h}"))

    rings = f"CASE WHEN area_id % 2 = 1 THEN [{ring(('cx - r', 'cy - r'), ('cx + r', 'cy - r'), ('cx', 'cy + r'))}] ELSE [{square('r')}, {square('(r * 6e-1)')}] END"
    return (
        f"{name}_given AS (SELECT n_nationkey AS area_id, {cx} AS cx, {cy} AS cy, {r} AS r FROM nation), {name} AS (SELECT area_id, {rings} AS rings FROM {name}_given), "
        f"{name}_ring AS (SELECT area_id, k AS ring, rings[k] AS points FROM (SELECT area_id, rings, unnest(generate_series(1, len(rings))) AS k FROM {name})), "
        f"{name}_edge AS (SELECT area_id, ring, i, points[i].x AS x1, points[i].y AS y1, points[i + 1].x AS x2, points[i + 1].y AS y2 FROM (SELECT *, unnest(generate_series(1, len(points) - 1)) AS i FROM {name}_ring))"
    )


AREA_SQL = shape_sql("area", "-122.45e0 + (n_nationkey * 7 % 41 - 20) * 2e-2", "37.80e0 + (n_nationkey * 11 % 37 - 18) * 2e-2", "3e-2 + (n_nationkey % 5) * 4e-2")
GRID_AREA_SQL = shape_sql("area", "-122.4964e0 + (n_nationkey % 3) * 1e-3", "37.8495e0 - (n_nationkey % 7) * 4e-4", "8e-4 + (n_nationkey % 5) * 6e-4")

#: Grids of even numbers and their sources lie on both sides of the border of zones 10 and 11, those of odd ones south of the
#: equator on that of 33 and 34: epsg, origin and steps of a target and of its source.
REFERENCES = (((32610, 764000.0, 4188000.0, 10.0, -10.0), (32611, 235700.0, 4188020.0, 20.0, -20.0)), ((32733, 780000.0, 6344700.0, 10.0, -10.0), (32734, 219380.0, 6344720.0, 20.0, -20.0)))


def references(spark: SparkSession) -> DataFrame:
    names = ("epsg", "origin_x", "origin_y", "res_x", "res_y")
    even = F.col("id") % 2 == 0
    values = {f"{p}{n}": F.when(even, REFERENCES[0][side][i]).otherwise(REFERENCES[1][side][i]) for side, p in enumerate(("", "source_")) for i, n in enumerate(names)}
    return spark.range(GRIDS).select(F.col("id").alias("grid_id"), F.col("id").alias("source_grid_id"), *(c.alias(n) for n, c in values.items()))
