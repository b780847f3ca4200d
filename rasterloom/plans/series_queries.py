"""Queries over time series, kept tables and free-text places."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import catalog, series
from rasterloom.plans import pipeline
from rasterloom.plans.registry import AREA, BOX, IN_BOX, MONTHLY, SEARCH, SERIES_SQL, YEAR, chosen_blocks_sql, register
from rasterloom.sources import fixtures as fx
from rasterloom.sources import tables
from rasterloom.streaming import items as stream

KEYS = ["grid_id", "collection"]
#: Monthly means of little-clouded scenes by grid and collection: months without one are missing.
SERIES_OF_CLOUD = "s AS (SELECT grid_id, collection, CAST(date_trunc('month', datetime) AS DATE) AS date, avg(cloud_cover) AS cloud FROM scene WHERE cloud_cover < 25 GROUP BY ALL)"


def cloud_series(spark, d):
    return series.monthly(fx.scenes(spark, d).filter("cloud_cover < 25"), KEYS, "datetime", "cloud_cover").withColumnRenamed("cloud_cover", "cloud")


@register(
    "series_with_gaps",
    f"WITH {fx.SCENE_SQL}, {SERIES_OF_CLOUD}, e AS (SELECT grid_id, collection, min(date) AS a, max(date) AS z FROM s GROUP BY ALL), "
    "spine AS (SELECT grid_id, collection, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS date FROM e) SELECT grid_id, collection, date, round(cloud, 6) AS cloud FROM spine LEFT JOIN s USING (grid_id, collection, date)",
)
def series_with_gaps(spark, d):
    return series.with_gaps(cloud_series(spark, d), KEYS, "cloud").withColumn("cloud", F.round("cloud", 6))


@register(
    "series_rolling_mean",
    f"WITH {fx.SCENE_SQL}, {SERIES_OF_CLOUD} SELECT grid_id, collection, date, round(avg(cloud) OVER (PARTITION BY grid_id, collection ORDER BY date RANGE BETWEEN INTERVAL 91 DAY PRECEDING AND CURRENT ROW), 6) AS rolling FROM s",
)
def series_rolling_mean(spark, d):
    return series.rolling_mean(cloud_series(spark, d), KEYS, "cloud", 92).select(*KEYS, "date", F.round("rolling", 6).alias("rolling"))


@register(
    "series_anomaly",
    f"WITH {fx.SCENE_SQL}, {SERIES_OF_CLOUD} SELECT a.grid_id, a.collection, a.date, CASE WHEN round(a.cloud - avg(b.cloud), 6) = 0 THEN 0e0 ELSE round(a.cloud - avg(b.cloud), 6) END AS anomaly FROM s a LEFT JOIN s b ON a.grid_id = b.grid_id AND a.collection = b.collection AND month(a.date) = month(b.date) AND a.date <> b.date GROUP BY a.grid_id, a.collection, a.date, a.cloud",
)
def series_anomaly(spark, d):
    rounded = F.round("anomaly", 6)  # without a negative zero
    return series.anomaly(cloud_series(spark, d), KEYS, "cloud").select(*KEYS, "date", F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias("anomaly"))


@register("stream_monthly_least_cloudy", f"WITH {fx.SCENE_SQL}, f AS (SELECT *, month(datetime) AS month FROM scene WHERE {SEARCH.format(cloud=60)}), g AS (SELECT *, {MONTHLY.format(keys='month')} FROM f) SELECT item_id, datetime, CAST(month AS INTEGER) AS month, cloud_cover FROM g WHERE r = 1")
def stream_monthly_least_cloudy(spark, d):
    """The monthly choice kept by a stream: scenes come in five files, a batch each, whose versions are then put into one."""
    path = tables.shared_path(spark, "stream")
    fx.scenes(spark, d).repartition(5, "item_id").write.parquet(f"{path}/in")
    new = stream.new_items(spark, f"{path}/in", fx.scenes(spark, d).schema, files_at_once=1)
    found = catalog.search(new, AREA, *YEAR, 60)
    stream.keep_monthly_best(found, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    kept = stream.monthly_best(catalog.search(fx.scenes(spark, d), AREA, *YEAR, 60)).schema
    stream.compact(spark, f"{path}/table", kept)
    return stream.current(spark, f"{path}/table", kept).select("item_id", "datetime", "month", "cloud_cover")


@register("series_refreshed", f"WITH {fx.SCENE_SQL}, {fx.PIXEL_SQL}, {chosen_blocks_sql(IN_BOX)}{SERIES_SQL}")
def series_refreshed(spark, d):
    """A stored series of the scenes seen first and some withdrawn later, then brought up to date with what came and went: as if
    computed at once from what there is."""
    path = tables.shared_path(spark, "series")
    own, px = fx.scenes(spark, d), fx.pixels(spark, d)
    later = F.col("cloud_cover") < 10
    withdrawn = own.filter(F.col("cloud_cover") > 50).withColumn("item_id", -F.col("item_id") - 1).withColumn("cloud_cover", F.lit(0.0))
    pipeline.refresh_series(spark, path, own.filter(~later).unionByName(withdrawn), None, px, AREA, BOX, *YEAR)
    pipeline.refresh_series(spark, path, own, own.filter(later), px, AREA, BOX, *YEAR, removed=withdrawn)
    return pipeline.stored_series(spark, path)


PLACES_SQL = "place AS (SELECT p_partkey AS place_id, p_name || ' ' || p_type AS name, p_brand AS address FROM part)"
#: Names misspelt, in part, in other case, and right.
ASKED_SQL = (
    "asked AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN name WHEN 1 THEN '  ' || upper(substr(name, 1, 4) || substr(name, 6)) WHEN 2 THEN substr(name, 1, 9) ELSE replace(name, 'e', 'i') END AS query "
    "FROM supplier JOIN place ON place_id = s_suppkey)"
)
PLAIN_SQL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
GRAMS_SQL = "list_distinct(list_transform(generate_series(1, greatest(length({0}), 1)), lambda i: substr(' ' || {0} || ' ', i, 3)))"


@register(
    "places_free_text",
    f"WITH {PLACES_SQL}, {ASKED_SQL}, q AS (SELECT query_id, {PLAIN_SQL.format('query')} AS q FROM asked), p AS (SELECT *, {PLAIN_SQL.format('name')} AS n FROM place), "
    f"qg AS (SELECT *, {GRAMS_SQL.format('q')} AS qg FROM q), pg AS (SELECT *, {GRAMS_SQL.format('n')} AS pg FROM p), "
    "c AS (SELECT query_id, place_id, name, address, levenshtein(q, n) AS distance, len(list_intersect(qg, pg)) AS shared, len(qg) AS asked FROM qg, pg WHERE len(list_intersect(qg, pg)) >= ceil(len(qg) * 4e-1)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, shared DESC, name, address, place_id) AS rank FROM c) "
    "SELECT query_id, place_id, name, CAST(rank AS INTEGER) AS rank, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 3",
)
def places_free_text(spark, d):
    """The three nearest places for each of some misspelt and partial names."""
    part = fx.read(spark, d, "part")
    places = part.select(F.col("p_partkey").alias("place_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_brand").alias("address"))
    name, key = F.col("name"), F.col("s_suppkey")
    broken = F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(F.lit("  "), F.upper(F.concat(F.substring(name, 1, 4), F.substr(name, F.lit(6)))))).when(key % 4 == 2, F.substring(name, 1, 9)).otherwise(F.replace(name, F.lit("e"), F.lit("i")))
    asked = fx.read(spark, d, "supplier").join(places, key == F.col("place_id")).select(key.alias("query_id"), broken.alias("query"))
    return catalog.search_places(places, catalog.place_index(places), asked, k=3).select("query_id", "place_id", "name", "rank", "distance")
