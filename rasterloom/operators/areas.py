"""Areas as tables: which items meet them, and which pixels lie in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.geometry import box_ring, boxes_meet, from_utm, pixel_centre, to_utm
from rasterloom.functions.polygons import box_of, box_within, edges, shapes_meet
from rasterloom.operators.raster import few

BOX = ("minx", "miny", "maxx", "maxy")
#: Cells of a level are so many degrees wide, each level's an eighth of the one's before.
LEVELS = tuple(360.0 / 8**k for k in range(5))


def shaped(areas: DataFrame) -> DataFrame:
    """Areas with their rings and their box: of a table of boxes the boxes' own rings."""
    if "rings" not in areas.columns:
        return areas.withColumn("rings", F.array(box_ring(*(F.col(c) for c in BOX))))
    return areas.withColumns(box_of(F.col("rings")))


def parts(items: DataFrame, key: str) -> DataFrame:
    """(key, BOX, rings) of items: the footprint's ring where there is one, else the box. A box that runs over the antimeridian
    (minx > maxx) becomes two."""
    ring = F.array("ring") if "ring" in items.columns else F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    box = {c: F.col(c) for c in BOX}

    def part(minx: Column, maxx: Column, rings: Column) -> Column:
        own = F.coalesce(rings, F.array(box_ring(minx, box["miny"], maxx, box["maxy"])))
        return F.struct(minx.alias("minx"), box["miny"].alias("miny"), maxx.alias("maxx"), box["maxy"].alias("maxy"), own.alias("rings"))

    ring = F.when(F.get(ring, F.lit(0)).isNotNull(), ring)
    whole = F.array(part(box["minx"], box["maxx"], ring))
    none = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    halves = F.array(part(box["minx"], F.lit(180.0), none), part(F.lit(-180.0), box["maxx"], none))
    return items.select(key, F.inline(F.when(box["minx"] > box["maxx"], halves).otherwise(whole)))


def level_of(box: dict[str, Column], finer: int = 0) -> Column:
    """The finest level whose cells are as large as a box, which then touches four at most; or a finer one than that."""
    extent = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    fit = F.lit(0)
    for k, width in enumerate(LEVELS):
        fit = F.when(extent <= width, k).otherwise(fit)
    return F.least(fit + finer, F.lit(len(LEVELS) - 1))


def cells(box: dict[str, Column], level: Column) -> Column:
    """The cells (level, i, j) of one level that a box touches."""
    width = F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)
    i, j = (F.sequence(F.floor((box[f"min{c}"] + 180) / width), F.floor((box[f"max{c}"] + 180) / width)) for c in "xy")
    return F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(level.alias("level"), a.alias("i"), b.alias("j")))))


def with_coarser(own: Column) -> Column:
    """Cells (own: true) and all coarser cells around them, each once."""

    def up(cell: Column) -> Column:
        def at(level: Column) -> Column:
            step = F.pow(F.lit(8.0), cell.level - level)
            return F.struct(level.alias("level"), F.floor(cell.i / step).alias("i"), F.floor(cell.j / step).alias("j"), (level == cell.level).alias("own"))

        return F.transform(F.sequence(F.lit(0), cell.level), at)

    return F.array_distinct(F.flatten(F.transform(own, up)))


def meeting(items: DataFrame, areas: DataFrame, key: str = "item_id", area: str = "area_id") -> DataFrame:
    """(key, area) of all items whose footprint shares a point with an area, each pair once.

    areas have rings (of polygons and their holes) or boxes. Both sides are covered by cells of a few levels, an item by four of
    its own size at most, an area by up to 17 x 17 of an eighth of its size of which those that it doesn't meet are left out; a
    pair is looked at if a cell of one lies in a cell of the other. An item within one cell that lies wholly inside the area
    needs no further test; all others' rings are compared edge by edge.
    """
    box = {c: F.col(c) for c in BOX}
    own = parts(items, key).withColumn("_own", cells(box, level_of(box)))
    single = (F.size("_own") == 1).alias("_single")
    item_cells = own.select(key, single, F.inline(with_coarser(F.col("_own"))))
    given = shaped(areas).select(area, "rings", *BOX)
    fine = given.select(area, "rings", F.inline(cells(box, level_of(box, finer=1))))
    width = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    corner = {c: F.col(i) * width - 180 for c, i in (("minx", "i"), ("miny", "j"))}
    square = {**corner, "maxx": corner["minx"] + width, "maxy": corner["miny"] + width}
    met = fine.filter(shapes_meet(F.array(box_ring(*(square[c] for c in BOX))), F.col("rings")))
    inner = met.withColumn("_inner", box_within(*(square[c] for c in BOX), F.col("rings")))
    as_cell = F.struct(F.col("level").alias("level"), F.col("i").alias("i"), F.col("j").alias("j"))
    area_cells = inner.select(area, "_inner", F.inline(with_coarser(F.array(as_cell)))).groupBy(area, "level", "i", "j", "own").agg(F.max(F.col("_inner") & F.col("own")).alias("_inner"))
    place = ["level", "i", "j"]
    near = item_cells.withColumnRenamed("own", "_mine").join(area_cells, place).filter(F.col("_mine") | F.col("own"))
    pairs = near.groupBy(key, area).agg(F.max(F.col("_single") & F.col("_inner")).alias("_settled"))
    ready = pairs.filter("_settled").select(key, area)
    rings = given.select(area, F.col("rings").alias("_area"), *(F.col(c).alias(f"_{c}") for c in BOX))
    open_ = pairs.filter("not _settled").join(own.drop("_own"), key).join(rings, area)
    open_ = open_.filter(boxes_meet(box, {c: F.col(f"_{c}") for c in BOX})).filter(shapes_meet(F.col("rings"), F.col("_area")))
    return ready.unionByName(open_.select(key, area).distinct())


def spans(areas: DataFrame, grids: DataFrame, keys: list[str], area: str = "area_id") -> DataFrame:
    """(keys, area, row, x0, x1): the intervals of each pixel row that areas cover, x0 included.

    areas (keys, area, rings in degrees) say for which grids they are meant; grids have epsg, origins, steps and sizes. Vertices
    are projected for each grid, and each edge gives its crossing with the rows' centre lines between its ends; between the
    first and the second crossing of a line, the third and the fourth and so on the line is inside.
    """
    placed = areas.select(*keys, area, "rings").join(grids.select(*keys, "epsg", "origin_x", "origin_y", "res_x", "res_y", "height"), keys)

    def moved(p: Column) -> Column:
        east, north = to_utm(p.x, p.y, F.col("epsg") % 100, F.floor(F.col("epsg") / 100) == 327)
        return F.struct(east.alias("x"), north.alias("y"))

    own = placed.withColumn("_rings", F.transform("rings", lambda ring: F.transform(ring, moved)))
    edge = own.select(*keys, area, "origin_y", "res_y", "height", F.inline(edges(F.col("_rings"))))
    first, last = ((F.col(c) - F.col("origin_y")) / F.col("res_y") - F.lit(0.5) for c in ("y1", "y2"))
    low = F.greatest(F.floor(F.least(first, last)), F.lit(0))  # a row too many at either end, left out below
    high = F.least(F.ceil(F.greatest(first, last)), F.col("height") - 1)
    lines = edge.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).filter("_low <= _high").withColumn("row", F.explode(F.sequence("_low", "_high")))
    y = F.col("origin_y") + (F.col("row") + F.lit(0.5)) * F.col("res_y")
    crossed = lines.filter((F.col("y1") > y) != (F.col("y2") > y))
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    met = crossed.groupBy(*keys, area, "row").agg(F.sort_array(F.collect_list(x)).alias("_xs"))  # as many as an area has edges
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("_xs", k * 2).alias("x0"), F.get("_xs", k * 2 + 1).alias("x1")))
    return met.select(*keys, area, "row", F.inline(pairs)).filter("x0 < x1")


def clip_to_areas(px: DataFrame, areas: DataFrame, grids: DataFrame, keys: list[str], area: str = "area_id", scenes: int | None = None) -> DataFrame:
    """Pixels whose centre lies in an area (keys, area, rings in degrees), once for each such area, beside its id. A pixel row
    is joined with the spans of its row, so neither the areas' number of vertices nor their holes reach the pixels. scenes: how
    many rows all spans together have at most, if that is known."""
    found = spans(areas, grids, keys, area)
    return px.join(few(found, scenes), [*keys, "row"]).filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).drop("x0", "x1")


def reproject_match(target: DataFrame, source: DataFrame, pairs: DataFrame, keys: list[str], bands: list[str], scenes: int | None = None) -> DataFrame:
    """target with the bands of grids in other reference systems: each pixel takes the source cell that its centre falls into,
    null where there is none.

    pairs has a row for each target grid: its keys, epsg, origin_x, origin_y, res_x and res_y, and the same of its source with
    source_ before the names. A centre goes to degrees and into the source's zone, unless both are the same, and its cell's
    row and column are looked up by an equi-join.
    """
    def zone(epsg: Column) -> tuple[Column, Column]:
        return epsg % 100, F.floor(epsg / 100) == 327

    names = ("epsg", "origin_x", "origin_y", "res_x", "res_y")
    own = {n: F.col(f"_{n}") for n in (*names, *(f"source_{n}" for n in names))}
    told = pairs.select(*keys, *(F.col(f"source_{k}").alias(f"_source_{k}") for k in keys), *(F.col(n).alias(f"_{n}") for n in own))
    wide = target.join(few(told, scenes), keys, "left")
    x, y = pixel_centre(F.col("col"), own["origin_x"], own["res_x"]), pixel_centre(F.col("row"), own["origin_y"], own["res_y"])
    wide = wide.withColumns({"_x": x, "_y": y})
    lon, lat = from_utm(F.col("_x"), F.col("_y"), *zone(own["epsg"]))
    wide = wide.withColumns({"_lon": lon, "_lat": lat})
    east, north = to_utm(F.col("_lon"), F.col("_lat"), *zone(own["source_epsg"]))
    same = own["epsg"] == own["source_epsg"]
    wide = wide.withColumns({"_x": F.when(same, F.col("_x")).otherwise(east), "_y": F.when(same, F.col("_y")).otherwise(north)})
    cell = {"_col": F.floor((F.col("_x") - own["source_origin_x"]) / own["source_res_x"]).cast("int"), "_row": F.floor((F.col("_y") - own["source_origin_y"]) / own["source_res_y"]).cast("int")}
    looked = wide.withColumns(cell)
    found = source.select(*(F.col(k).alias(f"_source_{k}") for k in keys), F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    joined = looked.join(found, [*(f"_source_{k}" for k in keys), "_row", "_col"], "left")
    return joined.drop("_x", "_y", "_lon", "_lat", "_row", "_col", *(f"_source_{k}" for k in keys), *(f"_{n}" for n in own))
