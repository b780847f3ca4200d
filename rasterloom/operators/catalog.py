"""The scene catalogue: search, choice of scenes, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.geometry import area_box, area_rings, box_ring, boxes_meet, check_dates, ring_meets_box
from rasterloom.functions.polygons import rings_literal, shapes_meet
from rasterloom.functions.scalar import asset_href, scene_label
from rasterloom.operators.areas import meeting

COLLECTION = "sentinel-2-l2a"


def search(items: DataFrame, area, start: str, end: str, max_cloud: float = 40, collections=(COLLECTION,)) -> DataFrame:
    """Items of the collections whose footprint meets the area, dated within both days, with less cloud than max_cloud.

    Items without a cloud cover don't match. The bounds are literals over plain columns, so all of them reach the scan. After
    that footprints are compared exactly: an item's ring, or its box where it has none, with the area's box, polygon or
    polygons, holes left out.
    """
    check_dates(start, end)
    minx, miny, maxx, maxy = area_box(area)
    day_after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    found = items.filter(F.col("collection").isin(*collections))
    found = found.filter((F.col("datetime") >= F.lit(start).cast("timestamp_ntz")) & (F.col("datetime") < day_after) & (F.col("cloud_cover") < max_cloud))
    own = {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}
    found = found.filter(boxes_meet(own, {"minx": F.lit(minx), "miny": F.lit(miny), "maxx": F.lit(maxx), "maxy": F.lit(maxy)}))
    if isinstance(area, dict):
        box = box_ring(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
        ring = F.coalesce(F.col("ring"), box) if "ring" in found.columns else box
        return found.filter(shapes_meet(F.array(ring), rings_literal(area_rings(area))))
    return found.filter(F.coalesce(ring_meets_box(F.col("ring"), minx, miny, maxx, maxy), F.lit(True))) if "ring" in found.columns else found


def in_area(items: DataFrame, areas: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that meet any of several areas, given by boxes or by rings (see areas.meeting); both tables may be large."""
    numbered = areas if "area_id" in areas.columns else areas.withColumn("area_id", F.monotonically_increasing_id())
    return items.join(meeting(items, numbered, key).select(key), key, "left_semi")


def least_cloudy(items: DataFrame, by_year: bool = False) -> DataFrame:
    """One item for each month, whatever the year (or each month of each year): the least cloudy, then the latest, then the
    smallest id. An unknown cover counts as 100."""
    cloud = F.coalesce("cloud_cover", F.lit(100.0))
    keyed = items.withColumn("month", F.month("datetime"))
    keys = ["month"]
    if by_year:
        keyed, keys = keyed.withColumn("year", F.year("datetime")), ["year", "month"]
    best = Window.partitionBy(*keys).orderBy(cloud.asc(), F.col("datetime").desc(), F.col("item_id").asc())
    return keyed.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def by_date(items: DataFrame) -> DataFrame:
    return items.orderBy("datetime", "item_id")


def newest(items: DataFrame, n: int = 1) -> DataFrame:
    return items.orderBy(F.col("datetime").desc(), "item_id").limit(n)


def nth(items: DataFrame, index: int) -> DataFrame:
    """The item at a position, counted from 0 by date: a top-k of index + 1 rows, then its last."""
    top = items.orderBy("datetime", "item_id").limit(index + 1)
    place = Window.orderBy("datetime", "item_id")  # over index + 1 rows
    return top.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") == index + 1).drop("_place")


def labelled(items: DataFrame) -> DataFrame:
    return items.withColumn("label", scene_label(F.col("item_id"), F.col("datetime"), F.col("cloud_cover")))


def pick(items: DataFrame, label: str) -> DataFrame:
    """The first item with a label, by date."""
    return labelled(items).filter(F.col("label") == label).orderBy("datetime", "item_id").limit(1)


def geocode(places: DataFrame, query: str) -> DataFrame:
    """The first place of that name, in any case; no row if it isn't known."""
    return places.filter(F.lower("name") == query.strip().lower()).orderBy("name", "address").limit(1)


def plain_name(name: Column) -> Column:
    """A name as it is compared: lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def grams(name: Column) -> Column:
    """The different runs of three characters of a plain name with a blank at either end."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def name_id(name: Column) -> Column:
    """What an index calls a plain name. Names that shared a hash would be told apart by what they are compared with afterwards."""
    return F.xxhash64(name)


def place_index(places: DataFrame) -> DataFrame:
    """(gram, name_id): the different plain names of places that hold a run of three characters; to be stored for searches."""
    names = places.select(plain_name(F.col("name")).alias("_name")).filter("_name is not null").distinct()
    return names.select(F.explode(grams(F.col("_name"))).alias("gram"), name_id(F.col("_name")).alias("name_id"))


def search_places(places: DataFrame, index: DataFrame, queries: DataFrame, k: int = 1, least: float = 0.4, key: str = "place_id") -> DataFrame:
    """The k places nearest to each free text (query_id, query), misspelt or in part: the places with their rank and distance.

    A place is looked at if its name holds at least that share of the query's runs of three characters. Places are ranked by
    edit distance, then by the runs they share, then by name, address and key. So many runs must be shared that one of the
    query's rarest is among them, whatever else is: only these are joined with the index, and frequent runs, which most names
    hold, never meet. Null and empty queries find nothing.

    Equal texts and equal plain names are compared once, however many queries and places have them. Names are ranked by the
    first of their places: a name behind k others has none among the k nearest, and of a name only its first k can be.
    """
    asked = queries.select("query_id", plain_name(F.col("query")).alias("_query")).filter("_query <> ''")
    texts = asked.select("_query").distinct().withColumn("_grams", grams(F.col("_query")))
    needed = F.greatest(F.ceil(F.size("_grams") * F.lit(least)), F.lit(1))
    known = index.groupBy("gram").agg(F.count("*").alias("_names"))
    each = texts.select("_query", needed.alias("_needed"), F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    order = Window.partitionBy("_query").orderBy(F.coalesce("_names", F.lit(0)), "gram")  # as many as a query has characters
    rare = each.join(known, "gram", "left").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("_n") - F.col("_needed") + 1)
    candidates = rare.join(index, "gram").select("_query", "name_id").distinct()
    named = places.withColumn("_name", plain_name(F.col("name"))).filter("_name is not null")
    same = Window.partitionBy("_name").orderBy("name", "address", key)
    first = named.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") <= k)
    names = first.filter("_place = 1").select("_name", *(F.col(c).alias(f"_first_{i}") for i, c in enumerate(("name", "address", key))), name_id(F.col("_name")).alias("name_id"), grams(F.col("_name")).alias("_own"))
    both = candidates.join(texts, "_query").join(names, "name_id")
    shared = F.size(F.array_intersect("_grams", "_own"))
    near = both.withColumn("_shared", shared).filter(F.col("_shared") >= F.ceil(F.size("_grams") * F.lit(least)))
    near = near.withColumn("distance", F.levenshtein("_query", "_name"))

    def nearest(rows: DataFrame, *ties: str) -> DataFrame:
        best = Window.partitionBy("_query").orderBy("distance", F.col("_shared").desc(), *ties)
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    some = nearest(near, *(f"_first_{i}" for i in range(3))).select("_query", "_name", "_shared", "distance")
    found = nearest(some.join(first, "_name"), "name", "address", key)
    return asked.join(found, "_query").select("query_id", *places.columns, "distance", "rank")


def skipped(items: DataFrame, used: DataFrame, key: str, reason: str = "no pixel in the area") -> DataFrame:
    """Items that gave no result, with the reason."""
    return items.join(used.select(key).distinct(), key, "left_anti").select(key, F.lit(reason).alias("reason"))


def count(items: DataFrame, name: str = "n") -> DataFrame:
    return items.agg(F.count("*").alias(name))


def signed(href: Column) -> Column:
    """Local data need no token: the address itself."""
    return href


def asset(items: DataFrame, key: str, name: str = "href") -> DataFrame:
    return items.withColumn(name, signed(asset_href(F.col("assets"), key)))


def remember(items: DataFrame, name: str) -> DataFrame:
    """Items kept under a name for the session, as a view that SQL can read; the view itself."""
    items.createOrReplaceTempView(name)
    return items.sparkSession.table(name)
