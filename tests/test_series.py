from __future__ import annotations

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import catalog, series
from rasterloom.plans import pipeline
from rasterloom.streaming import items as stream

AREA, BOX = (0.0, 0.0, 1.0, 1.0), (0.0, -99.0, 99.0, 0.0)
YEARS = ("2021-01-01", "2023-12-31")


def rows_of(spark, values):
    return spark.createDataFrame([(k, dt.date.fromisoformat(d), v) for k, d, v in values], "k string, date date, v double")


def test_gaps(spark):
    df = rows_of(spark, [("a", "2022-11-01", 1.0), ("a", "2023-02-01", 2.0), ("b", "2023-01-01", None)])
    got = [(r.k, str(r.date), r.v) for r in series.with_gaps(df, ["k"], "v").orderBy("k", "date").collect()]
    assert got == [("a", "2022-11-01", 1.0), ("a", "2022-12-01", None), ("a", "2023-01-01", None), ("a", "2023-02-01", 2.0), ("b", "2023-01-01", None)]
    whole = series.with_gaps(df, ["k"], "v", "2022-12-15", "2023-03-01").orderBy("k", "date").collect()
    assert [(r.k, str(r.date)) for r in whole] == [(k, d) for k in "ab" for d in ("2022-12-01", "2023-01-01", "2023-02-01", "2023-03-01")]
    assert series.with_gaps(df.limit(0), ["k"], "v").count() == 0 and series.with_gaps(df, ["k"], "v", "2023-02-01", "2023-01-01").count() == 0


def test_rolling_and_anomaly_against_loops(spark):
    draw = random.Random(3)
    days = sorted(draw.sample(range(1200), 150))
    values = [(k, str(dt.date(2020, 1, 1) + dt.timedelta(d)), None if draw.random() < 0.1 else draw.uniform(0, 9)) for k in "abc" for d in days]
    df = rows_of(spark, values)
    rolled = {(r.k, str(r.date)): r.rolling for r in series.rolling_mean(df, ["k"], "v", 40).collect()}
    for k, d, _ in values:
        last = [v for j, e, v in values if j == k and v is not None and 0 <= (dt.date.fromisoformat(d) - dt.date.fromisoformat(e)).days < 40]
        assert rolled[k, d] == (pytest.approx(sum(last) / len(last)) if last else None)
    monthly = series.monthly(df, ["k"], "date", "v")
    known = [(r.k, r.date, r.v) for r in monthly.collect()]
    for r in series.anomaly(monthly, ["k"], "v").collect():
        others = [v for k, d, v in known if k == r.k and d.month == r.date.month and d != r.date and v is not None]
        assert r.anomaly == (pytest.approx(r.v - sum(others) / len(others)) if others and r.v is not None else None)


NAMES = ["San Francisco", "San Fernando", "Santa Fe", "São Paulo", "Paris", "Paris", "Sacramento", "Fresno", "New York", "York"]


def test_free_text_places(spark):
    places = spark.createDataFrame([(i, n, f"address {i}") for i, n in enumerate(NAMES)], "place_id int, name string, address string")
    asked = {0: "san  FRANSISCO ", 1: "fransisco", 2: "paris", 3: "new yrok", 4: "zzzzz", 5: "", 6: None, 7: "Sao Paulo", 8: "sacrament", 9: "york"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got = {r.query_id: (r.name, r.place_id) for r in catalog.search_places(places, catalog.place_index(places), queries).collect()}
    assert got == {0: ("San Francisco", 0), 1: ("San Francisco", 0), 2: ("Paris", 4), 3: ("New York", 8), 7: ("São Paulo", 3), 8: ("Sacramento", 6), 9: ("York", 9)}
    two = catalog.search_places(places, catalog.place_index(places), queries, k=2).filter("query_id = 2").orderBy("rank").collect()
    assert [(r.rank, r.place_id, r.distance) for r in two] == [(1, 4, 0), (2, 5, 0)]


def test_free_text_places_against_all_pairs(spark):
    """Joining a query's rarest runs only loses no place that shares enough of them."""
    draw = random.Random(8)
    names = ["".join(draw.choice(["an", "be", "co", " "]) for _ in range(draw.randint(1, 9))).strip() or "an" for _ in range(400)]
    texts = ["".join(draw.choice(["an", "be", "co", "x", " "]) for _ in range(draw.randint(1, 7))) for _ in range(80)]
    places = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "place_id int, name string, address string")
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")

    def runs(s):
        s = f" {' '.join(s.split())} "
        return {s[i : i + 3] for i in range(max(len(s) - 2, 1))}

    for least in (0.3, 0.7, 1.0):
        want = {(q, i) for q, t in enumerate(texts) if t.split() for i, n in enumerate(names) if len(runs(t) & runs(n)) >= max(len(runs(t)) * least - 1e-9, 1)}
        found = catalog.search_places(places, catalog.place_index(places), queries, k=10_000, least=least)
        assert {(r.query_id, r.place_id) for r in found.collect()} == want


def test_free_text_places_of_one_name(spark):
    """Names that many places share, in several spellings, are compared once with each different text, and ranked place by place."""
    draw = random.Random(3)
    spelt = ["Paris", "paris", " PARIS", "Pariss", "Santa Fe", "santa  fe", "Santa Fee", "York"]
    rows = [(i, draw.choice(spelt), draw.choice([None, "a", "b"])) for i in range(400)] + [(400, None, "a")]
    places = spark.createDataFrame(rows, "place_id int, name string, address string")
    texts = ["paris", "PARIS", "pari", "santa fe", "sante fe", "york", None] * 3
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")

    def plain(s):
        return " ".join(s.lower().split())

    def runs(s):
        return {f" {s} "[i : i + 3] for i in range(len(s))}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = []
    for q, t in enumerate(texts):
        near = []
        for i, n, a in rows if t else ():
            if n and (both := len(runs(plain(t)) & runs(plain(n)))) >= 0.4 * len(runs(plain(t))):
                near.append((distance(plain(t), plain(n)), -both, n, a is not None, a or "", i))
        want += [(q, x[5], rank, x[0]) for rank, x in enumerate(sorted(near)[:3], 1)]
    index = catalog.place_index(places)
    got = catalog.search_places(places, index, queries, k=3)
    assert sorted(map(tuple, got.select("query_id", "place_id", "rank", "distance").collect())) == sorted(want)
    assert index.count() == sum(len(runs(n)) for n in {plain(n) for n in spelt})  # not once more for each place


ITEM = "item_id long, grid_id long, collection string, datetime timestamp_ntz, cloud_cover double, minx double, miny double, maxx double, maxy double"


def scenes(spark, rows):
    return spark.createDataFrame([(i, g, "sentinel-2-l2a", dt.datetime.fromisoformat(t), c, 0.2, 0.2, 0.4, 0.4) for i, g, t, c in rows], ITEM)


def pixels(spark):
    return spark.range(3 * 16).select((F.col("id") % 3).alias("grid_id"), F.floor(F.col("id") / 12).cast("int").alias("row"), (F.floor(F.col("id") / 3) % 4).cast("int").alias("col")).select(
        "*", F.col("col").cast("double").alias("x"), (-F.col("row")).cast("double").alias("y"), ((F.col("grid_id") + 1) * 10).cast("int").alias("b05"), ((F.col("grid_id") + 2) * (F.col("col") + 11)).cast("int").alias("b8a")
    )


def test_a_refresh_rewrites_the_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "series")
    old = [(1, 0, "2021-05-02", 30.0), (2, 1, "2021-06-02", 20.0), (3, 2, "2022-05-02", 10.0), (4, 0, "2023-01-02", 50.0)]
    new = [(5, 2, "2021-06-20", 5.0), (6, 1, "2022-07-01", 59.0), (7, 1, "2022-05-09", 90.0), (8, 9, "2023-01-05", 1.0)]  # 7 is too cloudy, 8 has no pixel
    px = pixels(spark)

    def files():
        return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}

    def kept():
        return [(r.item_id, str(r.date)) for r in pipeline.stored_series(spark, path).collect()]

    pipeline.refresh_series(spark, path, scenes(spark, old), None, px, AREA, BOX, *YEARS)
    before = files()
    assert kept() == [(1, "2021-05-02"), (2, "2021-06-02"), (3, "2022-05-02"), (4, "2023-01-02")]
    whole = scenes(spark, old + new)
    for _ in range(2):  # again: nothing changes
        pipeline.refresh_series(spark, path, whole, scenes(spark, new), px, AREA, BOX, *YEARS)
        assert kept() == [(1, "2021-05-02"), (5, "2021-06-20"), (3, "2022-05-02"), (6, "2022-07-01")]
    after = files()
    stay = {f for f in before if "year=2021/month=5" in f or "year=2022/month=5" in f}
    assert len(stay) == 2 and all(after.get(f) == before[f] for f in stay) and not (set(before) - stay) & set(after)
    again = str(tmp_path / "again")
    pipeline.refresh_series(spark, again, whole, None, px, AREA, BOX, *YEARS)
    assert [tuple(r) for r in pipeline.stored_series(spark, again).collect()] == [tuple(r) for r in pipeline.stored_series(spark, path).collect()]


@pytest.mark.parametrize("whole", [False, True])
def test_a_refresh_forgets_removed_scenes(spark, tmp_path, whole):
    """A month gets its next scene, or none; others' files stay unless the whole series is written."""
    path = str(tmp_path / "series")
    rows = [(1, 0, "2021-05-02", 30.0), (2, 1, "2021-06-02", 20.0), (3, 2, "2021-06-05", 10.0), (4, 0, "2023-01-02", 50.0), (5, 1, "2022-02-02", 1.0)]
    gone = [r for r in rows if r[0] in (3, 4)]
    left = scenes(spark, [r for r in rows if r not in gone] + [(6, 0, "2022-03-01", 2.0)])
    px = pixels(spark)
    pipeline.refresh_series(spark, path, scenes(spark, rows), None, px, AREA, BOX, *YEARS)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    new = (None, {}) if whole else (scenes(spark, [(6, 0, "2022-03-01", 2.0)]), {"removed": scenes(spark, gone)})
    for _ in range(2):
        pipeline.refresh_series(spark, path, left, new[0], px, AREA, BOX, *YEARS, **new[1])
        found = [(r.item_id, str(r.date)) for r in pipeline.stored_series(spark, path).collect()]
        assert found == [(1, "2021-05-02"), (2, "2021-06-02"), (5, "2022-02-02"), (6, "2022-03-01")]
    stay = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len(stay) == (0 if whole else 2)


def test_the_monthly_choice_as_a_stream(spark, tmp_path):
    """Files in several batches, more files later, and a batch that comes again: the table is that of all items."""
    draw = random.Random(4)
    rows = [(i, 0, f"20{draw.choice([21, 22])}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", draw.choice([None, 5.0, 5.0, 7.5, 90.0])) for i in range(300)]
    table, folder = str(tmp_path / "table"), str(tmp_path / "in")

    def arrive(some):
        scenes(spark, some).repartition(3).write.mode("append").parquet(folder)
        new = stream.new_items(spark, folder, scenes(spark, some).schema, files_at_once=1)
        stream.keep_monthly_best(new, table, str(tmp_path / "checkpoint")).awaitTermination()

    def check(some):
        own = scenes(spark, some)
        got = stream.current(spark, table, stream.monthly_best(own).schema)
        want = catalog.least_cloudy(own).select("month", "item_id", "datetime", "cloud_cover")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    arrive(rows[:200])
    check(rows[:200])
    arrive(rows[200:])
    check(rows)
    last = max(int(p.name.split("=")[1]) for p in Path(table).glob("batch=*"))
    assert last >= 4
    again = spark.read.parquet(f"{table}/batch={last}").cache()
    again.count()
    stream.upsert(again, last, table)
    again.unpersist()
    check(rows)
    schema = stream.monthly_best(scenes(spark, rows)).schema
    aside = tmp_path / "aside"
    shutil.copytree(table, aside)
    for cut_off in (False, True, False):
        if cut_off:  # the old versions are still there beside the new one
            shutil.copytree(aside, table, dirs_exist_ok=True)
        stream.compact(spark, table, schema)
        assert [p.name for p in Path(table).glob("batch=*")] == [f"batch={last + 0.5}"]
        check(rows)
    more = [(1000 + m, 0, f"2022-{m:02}-28", 0.0) for m in (2, 9)]
    arrive(more)
    check(rows + more)
    newest = max(float(p.name.split("=")[1]) for p in Path(table).glob("batch=*"))
    assert newest > last + 0.5
    stream.compact(spark, table, schema)
    assert [p.name for p in Path(table).glob("batch=*")] == [f"batch={newest + 0.5}"]
    check(rows + more)
