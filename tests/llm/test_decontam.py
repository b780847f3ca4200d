from __future__ import annotations

import random
import re

from rasterloom.llm import decontam

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute(rows, items):
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            if item is None or not v:
                continue
            for i in range(max(len(v) - 12, 1)):
                win = v[i : i + 13]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df, items):
    return sorted((tuple(r)[:5] for r in decontam.decontaminate(df, items).collect()), key=repr)


def test_equals_brute_force(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_HASHES", 40)  # several blocks
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    draw = random.Random(6)
    items = [(i, prose(100 + i, draw.choice([1, 2, 3, 4, 5, 7, 12, 13, 14, 30]))) for i in range(20)]
    items += [(20, items[0][1]), (20, items[1][1]), (21, None), (22, ""), (None, prose(999, 20)), (23, "the the the the the the the the the the the the the the")]
    rows = []
    for i in range(40):
        t = prose(i, draw.randrange(0, 120)).split()
        for _ in range(draw.randrange(3)):
            own = (draw.choice(items)[1] or "").split()
            at = draw.randrange(len(t) + 1)
            t[at:at] = own[draw.randrange(3) :]
        rows.append((i, draw.choice([" ", ", ", "\n"]).join(t).upper() if i % 3 else " ".join(t)))
    rows += [(100, None), (101, ""), (102, "the " * 40), (103, items[5][1]), (103, "other text"), (None, items[6][1]), (104, "É" + items[7][1])]
    found = got(docs(rows), spark.createDataFrame(items, ITEMS))
    assert found == brute(rows, items)
    assert any(r[4] for r in found) and not all(r[4] for r in found)


def test_repeated_rows_and_empty_tables(spark, docs, prose):
    items = spark.createDataFrame([(1, prose(3, 20))], ITEMS)
    rows = [(1, prose(3, 20)), (1, prose(3, 20))]
    assert got(docs(rows), items) == brute(rows, [(1, prose(3, 20))])
    assert got(docs([]), items) == [] and got(docs(rows), items.limit(0)) == [(1, 20, 0, [], False)] * 2


def test_very_long_text(spark, docs, prose):
    item = prose(3, 40)
    rows = [(1, prose(7, 40_000) + " " + item + " " + prose(8, 40_000)), (2, "word" * 20_000), (3, item)]
    assert got(docs(rows), spark.createDataFrame([(1, item)], ITEMS)) == brute(rows, [(1, item)])


def test_clashing_columns(spark, docs, prose):
    df = docs([(1, prose(3, 20))]).toDF("doc_id", "text", "window", "hash", "id")
    assert got(df, spark.createDataFrame([(1, prose(3, 20))], ITEMS).selectExpr("*", "'x' as window", "1 as doc_id"))[0][4]
