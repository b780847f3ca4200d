from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import near_dup as nd
from rasterloom.llm.common import scratch_dir

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for k in groups[find(i)] if k is not None]
        least = min(ids) if ids and sets[i] else key
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, nd.near_duplicates(df).collect()), key=repr)


def edited(draw, words, n):
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"edit{draw.randrange(10**9)}"
    return " ".join(out)


def test_equals_brute_force(docs, prose):
    draw = random.Random(2)
    rows, at = [], 0
    for base in range(6):
        words = prose(base, 80).split()
        for n in [0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 6]:
            rows.append((at * 7 % 101, edited(draw, words, n)))
            at += 1
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "One\ttwo"), (505, "one two three"), (506, "É É É É É"), (507, "é é é é é")]
    assert got(docs(rows)) == brute(rows)


def test_many_near_copies_of_one_text(docs, prose):
    """A hot group whose members are near or far from each other, some linked only over others."""
    draw = random.Random(4)
    words = prose(77, 150).split()
    rows = [(i, edited(draw, words, draw.randrange(0, 9))) for i in range(240)]
    assert got(docs(rows)) == brute(rows)


def near_copies(prose, n, places, kinds):
    """n copies of a text that isn't among them, each edited in some of its places, by one of so many kinds of edits."""
    words, draw = prose(77, 100).split(), random.Random(5)
    for i in range(n):
        out = list(words)
        for k in draw.sample(range(0, 100, 100 // places), draw.choice([2, 2, 3]) if places > 10 else 2):
            out[k] = f"edit{draw.randrange(kinds)}"
        yield i, " ".join(out)


@pytest.fixture
def matches(monkeypatch):
    """How many pairs of entries the join of differences looked at, and how many pairs were left of them."""
    counts, save = {}, nd.Scratch.save

    def counted(self, df, name, files=None):
        out = save(self, df, name, files)
        if name == "keys":
            both = F.when(F.col("lo") == F.col("hi"), F.col("n_hi") * (F.col("n_hi") - 1) / 2).otherwise(F.col("n_lo") * F.col("n_hi"))
            counts["keys"] = out.agg(F.coalesce(F.sum(both), F.lit(0))).first()[0]
        if name == "met":
            counts["pairs"] = out.count()
        return out

    monkeypatch.setattr(nd.Scratch, "save", counted)
    return counts


@pytest.mark.parametrize(("places", "kinds"), [(10, 10**9), (100, 10**9), (100, 20)])
def test_hot_group_equals_brute_force(docs, prose, matches, places, kinds):
    """Most pairs lie just below the threshold, and few reach the comparison of sketches."""
    rows = list(near_copies(prose, 400, places, kinds))
    assert got(docs(rows)) == brute(rows)
    assert 50 * matches["pairs"] < 400 * 399 / 2, matches


def test_key_matches_of_a_hot_group_grow_slowly(docs, prose, matches):
    """What the join looks at, before any condition: a small multiple of the rows, at every size."""
    for n in (300, 600, 1200, 2400):
        got(docs(near_copies(prose, n, 100, 10**9)))
        assert matches["keys"] < 50 * n, (n, matches)


@pytest.mark.parametrize("seed", range(4))
def test_mixed_groups_equal_brute_force(docs, prose, seed):
    """Texts of several lengths that share passages, cut and edited: near and far classes, of many levels, in one group."""
    draw, rows = random.Random(seed), []
    parts = [prose(100 * seed + k, 40).split() for k in range(4)]
    for i in range(160):
        body = [w for part in draw.sample(parts, draw.randint(1, 3)) for w in part]
        body = body[draw.randrange(6) : len(body) - draw.randrange(6)]
        rows.append((i, edited(draw, body, draw.randrange(4)) if draw.random() < 0.7 else " ".join(body)))
    assert got(docs(rows)) == brute(rows)


def test_a_cluster_needs_a_shared_folder():
    """On a cluster the shared folder must be named; a local master may do without."""

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default), "set": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert scratch_dir(Session).startswith("file://")


def test_chain_is_one_component(docs, prose):
    words = prose(5, 100).split()
    rows = [(50 - i, " ".join(words[i * 2 :] + prose(99, 100).split()[: i * 2])) for i in range(30)]
    assert got(docs(rows)) == brute(rows)


def test_repeated_rows_and_null_ids(docs, prose):
    text = prose(8, 30)
    rows = [(3, text), (3, text), (None, text), (9, text + " more"), (None, "alone in the world of words")]
    found = got(docs(rows))
    assert found == sorted([(3, 26, 3, True), (3, 26, 3, True), (None, 26, 3, False), (9, 27, 3, False), (None, 2, None, True)], key=repr)


def test_long_text_and_empty_table(docs, prose):
    long = prose(1, 30_000)
    found = got(docs([(1, long), (2, long + " x"), (3, "z" * 50_000)]))
    assert [r[2] for r in found] == [1, 1, 3]
    assert got(docs([])) == []


def test_clashing_columns(docs, prose):
    df = docs([(1, prose(1, 20)), (2, prose(1, 20))]).toDF("doc_id", "text", "node", "component_id", "kept")
    assert [r[2] for r in got(df)] == [1, 1]


def test_sketch_tells_similarity():
    h = nd.hasher()
    draw = np.random.default_rng(3)
    for share in (0.75, 0.9):
        total = 4000
        common = int(total * share)
        pool = draw.integers(0, 1 << 63, total, np.uint64)
        a, b = pool[: common + (total - common) // 2], np.r_[pool[:common], pool[common + (total - common) // 2 :]]
        s = h.odd_sketch(h.samples(np.r_[a, b], np.array([len(a), len(b)])))
        bits = sum(int(x ^ y).bit_count() if (x ^ y) >= 0 else int((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(s[0].tolist(), s[1].tolist(), strict=True))
        assert bits <= nd.sketch_limit(0.75)
    a, b = draw.integers(0, 1 << 63, 1000, np.uint64), draw.integers(0, 1 << 63, 1000, np.uint64)
    s = h.odd_sketch(h.samples(np.r_[a, b], np.array([1000, 1000])))
    assert sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(s[0].tolist(), s[1].tolist(), strict=True)) > nd.sketch_limit(0.75)
