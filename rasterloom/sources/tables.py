"""Sources: scene catalogues as Parquet or STAC JSON, pixel tables as Parquet, areas as literal tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.geometry import area_box, area_rings
from rasterloom.functions.polygons import rings_literal
from rasterloom.schemas import ITEMS, PIXELS, require

PIXEL_KEYS = ("scene_id", "row", "col", "x", "y")
STAC = "id string, collection string, bbox array<double>, properties struct<datetime:string,`eo:cloud_cover`:double>, geometry struct<type:string,coordinates:array<array<array<double>>>>, assets map<string,struct<href:string>>"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which goes when the session's JVM ends; on a local master that names
    none, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    own = f"{root.rstrip('/')}/rasterloom-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder), files.deleteOnExit(folder)
    return f"{own}/{name}"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue in Parquet with the columns of ITEMS."""
    return require(spark.read.parquet(path), *ITEMS.fieldNames())


def stac_items(raw: DataFrame) -> DataFrame:
    """Parsed STAC items in the columns of ITEMS. Times become UTC."""
    ring = F.transform(F.get("geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    at = F.to_timestamp_ntz(F.regexp_replace("properties.datetime", r"(?:Z|\+00:00)$", ""))
    return raw.select(
        F.col("id").alias("item_id"), "collection", at.alias("datetime"), F.col("properties.`eo:cloud_cover`").alias("cloud_cover"),
        *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("minx", "miny", "maxx", "maxy"))), ring.alias("ring"), "assets",
    )


def read_stac(spark: SparkSession, path: str) -> DataFrame:
    """STAC items as JSON lines, in the columns of ITEMS. Unknown properties are left unread."""
    return stac_items(spark.read.schema(STAC).json(path))


#: Longest part of a broken line that a report quotes.
QUOTED = 200


def checked_stac(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The usable items of a catalogue as JSON lines, and the others (item_id, reason, line) with the first reason that applies.

    A line that can't be parsed, has no id, no time that can be read, no box of four finite numbers or no collection stops
    nothing: it is listed, the others go on. Blank lines are passed over.
    """
    kind = T.StructType.fromDDL(STAC).add("_broken", T.StringType())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("_line"), F.from_json("value", kind, {"columnNameOfCorruptRecord": "_broken"}).alias("_item")).select("_line", "_item.*")
    box = F.coalesce(F.size("bbox") >= 4, F.lit(False)) & F.coalesce(F.forall(F.slice("bbox", 1, 4), lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    time = F.try_to_timestamp(F.regexp_replace("properties.datetime", r"(?:Z|\+00:00)$", ""))
    reason = (
        F.when(F.col("_broken").isNotNull(), "not a readable item").when(F.coalesce(F.col("id"), F.lit("")) == "", "no id").when(time.isNull(), "no time").when(~box, "no box").when(F.col("collection").isNull(), "no collection")
    )
    judged = parsed.withColumn("_reason", reason)
    rejected = judged.filter("_reason is not null").select(F.col("id").alias("item_id"), F.col("_reason").alias("reason"), F.left("_line", F.lit(QUOTED)).alias("line"))
    return stac_items(judged.filter("_reason is null")), rejected


def checked_pixels(spark: SparkSession, path: str, bands: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The pixels of the usable files below a path, and the other files (file, reason).

    All files are read under the schema of PIXELS with these bands; what isn't Parquet is passed over. A file is left out
    if no row of it can be read, or if a band has no value in it, as where its column is missing. Pixels stay where they are:
    the addresses of files that lack a band, some of those that the driver has listed, are broadcast.
    """
    address = F.col("_metadata.file_path").alias("_address")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(plain_path(F.col("path")).alias("file"), address)
    kept = T.StructType([f for f in PIXELS.fields if f.name in PIXEL_KEYS or f.name in bands])
    px = spark.read.schema(kept).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").parquet(path).select("*", address)
    seen = px.groupBy("_address").agg(F.count("*").alias("_rows"), *(F.count(b).alias(f"_n_{b}") for b in bands))
    lacks = F.array_compact(F.array(*(F.when(F.col(f"_n_{b}") == 0, b) for b in bands)))
    reason = F.when(F.coalesce("_rows", F.lit(0)) == 0, "no readable row").when(F.size(lacks) > 0, F.concat(F.lit("no value of "), F.array_join(lacks, ", ")))
    rejected = listed.join(seen, "_address", "left").select("file", reason.alias("reason")).filter("reason is not null")
    bad = seen.filter(F.size(lacks) > 0).select("_address")
    return px.join(F.broadcast(bad), "_address", "left_anti").drop("_address"), rejected


def plain_path(address: Column) -> Column:
    """A file's address without its scheme, which readers write in different ways."""
    return F.regexp_replace(address, "^[a-z]+:/+", "/")


def write_stac(items: DataFrame, path: str) -> None:
    """Items with the columns of ITEMS (the key as text or number) as STAC JSON lines."""
    properties = F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p.x, p.y))).alias("coordinates"))
    box = F.array("minx", "miny", "maxx", "maxy")
    items.select(F.col("item_id").cast("string").alias("id"), "collection", box.alias("bbox"), properties.alias("properties"), geometry.alias("geometry"), "assets").write.json(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A pixel table in Parquet, best partitioned by scene and sorted by position, so that boxes prune row groups. Its key,
    indices and coordinates are required, and at least one band of PIXELS."""
    px = require(spark.read.parquet(path), *PIXEL_KEYS)
    if not [b for b in PIXELS.fieldNames() if b not in PIXEL_KEYS and b in px.columns]:
        raise ValueError("a pixel table needs a band")
    return px


#: Rows and columns of a stored tile, and of the folder that smaller ones share: a folder holds a million pixels at most.
TILE = 1024
#: The folder of a stored pixel, beside its scene.
FOLDER = ("folder_row", "folder_col")


def tile_of(index: Column, tile: int = TILE) -> Column:
    return F.floor(index / tile).cast("int")


def folder_side(tile: int = TILE) -> int:
    """Rows and columns of a folder: so many whole tiles as TILE holds, or one larger tile. A folder for each of many small tiles
    would cost more than its pixels, to write, to list and to open."""
    return tile * max(TILE // tile, 1)


def write_pixels(px: DataFrame, path: str, tile: int = TILE) -> None:
    """A pixel table laid out for window reads: one folder for a scene's tile (folder_row, folder_col), or for a square of tiles
    where they are smaller than TILE, in the order of its tiles, their rows and columns. A window's folders are found by joining
    wanted (scene_id, folder_row, folder_col): others aren't opened."""
    side, place = folder_side(tile), ("scene_id", *FOLDER)
    cut = px.withColumns({f: tile_of(F.col(c), side) for f, c in zip(FOLDER, ("row", "col"), strict=True)})
    inner = (tile_of(F.col("row"), tile), tile_of(F.col("col"), tile), "row", "col")
    cut.repartition(*place).sortWithinPartitions(*place, *inner).write.partitionBy(*place).parquet(path)


def areas(spark: SparkSession, *given) -> DataFrame:
    """A table of areas (boxes, GeoJSON polygons or multipolygons), one row each: area_id, box and rings."""
    rows = [F.struct(F.lit(i).alias("area_id"), *(F.lit(v).alias(c) for v, c in zip(area_box(a), ("minx", "miny", "maxx", "maxy"), strict=True)), rings_literal(area_rings(a)).alias("rings")) for i, a in enumerate(given)]
    return spark.range(1).select(F.inline(F.array(*rows)))
