"""A stream of new scenes: files that arrive in a folder, filtered as in a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.operators.catalog import search


def new_items(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def matching(items: DataFrame, area, start: str, end: str, max_cloud: float = 40, late: str = "30 days", event_time: str = "datetime") -> DataFrame:
    """Each matching scene once, though its file may come again; ids are forgotten as far behind the newest as `late`."""
    found = search(items, area, start, end, max_cloud).withColumn("seen_at", F.col(event_time).cast("timestamp"))
    return found.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["item_id"])


def monthly_best(items: DataFrame) -> DataFrame:
    """The monthly choice of `least_cloudy` as a running state: of each month number the least cloudy item so far, then the
    latest, then the smallest id. The state is one row for a month; in update mode a batch gives the months that changed."""
    latest = -F.unix_micros(F.col("datetime").cast("timestamp"))
    order = F.struct(F.coalesce("cloud_cover", F.lit(100.0)).alias("cloud"), latest.alias("latest"), F.col("item_id").alias("item_id"), "datetime", "cloud_cover")
    best = items.groupBy(F.month("datetime").alias("month")).agg(F.min(order).alias("best"))
    return best.select("month", "best.item_id", "best.datetime", "best.cloud_cover")


def upsert(batch: DataFrame, number: int, path: str) -> None:
    """Keep a batch's rows as a version of their own, under its number: a batch that comes again after a failure replaces itself."""
    batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def current(spark: SparkSession, path: str, schema: T.StructType, key: str = "month") -> DataFrame:
    """The newest version of each key."""
    newest = Window.partitionBy(key).orderBy(F.col("batch").desc())
    rows = spark.read.schema(T.StructType(schema.fields).add("batch", T.DoubleType())).parquet(path)
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "batch")


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str = "month") -> None:
    """Put one version, numbered half a batch after the newest, in place of all that are there, while no stream writes.

    The new version is whole before its folder gets its name, and the old ones are removed after that: a run that is cut off
    anywhere leaves a table with the same rows, and the next one ends its work. A batch that comes again afterwards has a
    lower number and the rows that it had.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(jvm.Path(path))]
    versions = sorted((n for n in names if n.startswith("batch=")), key=lambda n: float(n.split("=")[1]))
    if len(versions) < 2:
        return
    last = versions[-1]
    if float(last.split("=")[1]).is_integer():
        current(spark, path, schema, key).write.mode("overwrite").parquet(f"{path}/_compacted")
        last = f"batch={float(last.split('=')[1]) + 0.5}"
        if not files.rename(jvm.Path(f"{path}/_compacted"), jvm.Path(f"{path}/{last}")):
            raise OSError(f"{path}/{last} can't be named")
    for old in versions:
        if old != last:
            files.delete(jvm.Path(f"{path}/{old}"), True)


def keep_monthly_best(items: DataFrame, path: str, checkpoint: str):
    """A query that takes in what there is of new items and keeps the table of monthly choices at path up to date."""
    best = monthly_best(items)
    writer = best.writeStream.outputMode("update").foreachBatch(lambda batch, number: upsert(batch, number, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
