from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from rasterloom.llm import learn, quality, toxicity
from rasterloom.llm.common import fold

LABELS = "doc_id long, quality int, toxic int"


def corpus(prose, n=400):
    """Texts, and labels: insults make a text toxic, shouting and repetition make it bad."""
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        w = prose(i, draw.randrange(30, 120)).split()
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                w[draw.randrange(len(w))] = draw.choice(["idiot", "moron,", "Scum", "loser."])
        text = " ".join(w)
        if bad:
            text = " ".join(x.upper() + "!!" for x in w) if i % 8 else " ".join(x for x in w[:10] for _ in range(12))
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def held(i, modulus, part):
    return zlib.crc32(str(i).encode()) % modulus == part


@pytest.fixture
def world(spark, docs, prose):
    rows, labels = corpus(prose)
    return docs(rows), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels}


def test_toxicity_on_held_out_rows(world):
    df, labels, truth = world
    model = toxicity.train(df, labels, toxicity.learnt())
    assert {"idiot", "moron", "scum", "loser"} <= set(model.lexicon)
    got = [(r.doc_id, r.toxicity) for r in toxicity.score(df, model).collect()]
    out = [(p >= 0.5) == bool(truth[i][1]) for i, p in got if held(i, 5, 0)]
    assert len(out) > 40 and np.mean(out) > 0.95
    assert all(0 <= p <= 1 for _, p in got)


def test_quality_on_held_out_rows(world):
    df, labels, truth = world
    model = quality.train(df, labels, quality.learnt())
    assert 0 < len(model.rules) < 300  # of some 800 paths
    got = [(r.doc_id, r.quality_score) for r in quality.score(df, model).collect()]
    out = [(p >= 0.5) == bool(truth[i][0]) for i, p in got if held(i, 3, 1)]
    assert len(out) > 80 and np.mean(out) > 0.95


def test_held_out_labels_are_never_learnt(world, spark):
    df, labels, _ = world
    other = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(df, labels, toxicity.learnt()).lexicon == toxicity.train(df, other, toxicity.learnt()).lexicon
    other = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(df, labels, quality.learnt()) == quality.train(df, other, quality.learnt())


def test_odd_rows(spark, docs, prose, world):
    df, labels, _ = world
    t, q = toxicity.train(df, labels, toxicity.learnt()), quality.train(df, labels, quality.learnt())
    rows = [(1, None), (2, ""), (None, "you idiot, you moron"), (3, "x " * 30_000 + "idiot moron scum loser"), (3, "same"), (3, "same")]
    odd = docs(rows).toDF("doc_id", "text", "toxicity", "quality_score", "passages")
    got = {(r.doc_id, (r.text or "")[:4]): r for r in toxicity.score(odd, t).collect()}
    assert len(toxicity.score(odd, t).collect()) == 6 and got[None, "you "].toxicity > 0.5
    assert [p["begin"] for p in got[3, "x x "].passages] == [30_000]
    assert got[1, ""].toxicity == got[2, ""].toxicity
    scores = {(r.doc_id, (r.text or "")[:4]): r.quality_score for r in quality.score(odd, q).collect()}
    assert len(quality.score(odd, q).collect()) == 6 and scores[1, ""] == scores[2, ""]
    assert toxicity.score(docs([]), t).count() == 0 and quality.score(docs([]), q).count() == 0


def test_without_labels(spark, docs, world):
    df, labels, _ = world
    model = toxicity.train(df, labels.limit(0), toxicity.learnt())
    assert {round(r.toxicity, 3) for r in toxicity.score(df, model).collect()} == {0.0}
    model = quality.train(df, labels.limit(0), quality.learnt())
    assert {r.quality_score for r in quality.score(df, model).collect()} == {0.5}


def test_training_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (3, 0, 1)]
    df = spark.createDataFrame(rows, LABELS)
    assert sorted(map(tuple, learn.training_labels(df, "quality", F.lit(True)).collect())) == [(1, 1), (3, 0)]
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert 300 < learn.training_labels(many, "quality", F.lit(True), most=500).count() < 700


def test_segments_equal_brute_force():
    """All maximal scoring segments by Ruzzo and Tompa's definition: recursively the best one, then left and right of it."""

    def brute(scores, base=0):
        best = None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j + 1, total)
        if best is None:
            return []
        i, j, s = best
        return [*brute(scores[:i], base), (base + i, base + j, s), *brute(scores[j:], base + j)]

    draw = random.Random(9)
    for _ in range(300):
        n = draw.randrange(1, 25)
        at = sorted(draw.sample(range(n), draw.randrange(0, n)))
        own = [draw.choice([0.5, 1.0, 2.75, 4.3]) + draw.random() / 100 for _ in at]
        full = [-0.4] * n
        for p, s in zip(at, own, strict=True):
            full[p] = s
        got = toxicity.segments(at, own, -0.4)
        want = brute(full)
        assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_compiled_rules_equal_numpy(spark, world):
    df, labels, _ = world
    model = quality.train(df, labels, quality.learnt())
    rows = df.select(*quality.statistics(F.col("text"), "_s_"), quality.statistics(F.col("text"))[0]).select(*(f"_s_{n}" for n in quality.NAMES), quality.compiled(model, "_s_").alias("p")).toPandas()
    x = rows[[f"_s_{n}" for n in quality.NAMES]].to_numpy()
    z = sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True)) + model.intercept
    assert np.allclose(rows["p"], 1 / (1 + np.exp(-z)))


def test_clashing_columns(docs, world):
    df, labels, _ = world
    t, q = toxicity.train(df, labels, toxicity.learnt()), quality.train(df, labels, quality.learnt())
    odd = docs([(1, "idiot moron scum loser")]).selectExpr("doc_id", "text as Text", "1 as _statistic_chars", "2 as Quality_Score", "3 as Toxicity", "4 as PASSAGES", "5 as `a.b`", "6 as c1")
    scored, judged = quality.score(odd, q), toxicity.score(odd, t)
    assert scored.columns == ["doc_id", "Text", "_statistic_chars", "Toxicity", "PASSAGES", "a.b", "c1", "quality_score"] and 0 <= scored.first().quality_score <= 1
    assert judged.columns == ["doc_id", "Text", "_statistic_chars", "Quality_Score", "a.b", "c1", "toxicity", "passages"]
    assert tuple(scored.first())[:-1] == (1, "idiot moron scum loser", 1, 3, 4, 5, 6) and judged.first().toxicity > 0.5


def test_extreme_value_law():
    """K and lambda are found again from best scores drawn by the law, texts without a segment and other units of score included."""
    draw = np.random.default_rng(3)
    for k, scale in ((0.05, 1.0), (0.2, 0.5), (0.02, 3.0)):
        n = draw.integers(20, 400, 6000).astype(float)
        s = (np.log(k * n) - np.log(-np.log(draw.random(6000)))) / scale
        floor = np.quantile(s, 0.3)
        found, fitted = toxicity.extreme_value([(a, b if b > max(floor, 0) else 0.0) for a, b in zip(n.tolist(), s.tolist(), strict=True)])
        assert abs(fitted / scale - 1) < 0.1 and abs(np.log(found / k)) < 0.4
    assert toxicity.extreme_value([]) == (1.0, 1.0) and toxicity.extreme_value([(10, 0.0)])[1] == 1.0
    k, scale = toxicity.extreme_value([(100, 2.0), (50, 0.0)])
    assert scale == 1.0 and abs(k - 1 / (150 * np.exp(-2.0))) < 1e-9


def test_log_odds_and_score_against_loops(docs, world):
    """The lexicon from counts in plain Python, and a text's score from its segments, the law and the logistic weights."""
    df, labels, truth = world
    model = toxicity.train(df, labels, toxicity.learnt())
    texts = {r.doc_id: r.text for r in df.collect()}
    chosen = [i for i in texts if i in truth and not held(i, 5, 0)]
    counts = {}
    for i in chosen:
        for w in set(toxicity.WORD.findall(texts[i].lower())):
            counts.setdefault(w, [0, 0])[truth[i][1] > 0] += 1
    n_c, n_t = (sum(c[k] for c in counts.values()) for k in (0, 1))
    want = {}
    for w, (clean, toxic) in counts.items():
        t, c = toxic + toxicity.PRIOR, clean + toxicity.PRIOR
        odds = np.log(t / (n_t - t + 1)) - np.log(c / (n_c - c + 1))
        if odds / np.sqrt(1 / t + 1 / c) >= toxicity.MIN_Z and np.log(t / n_t) - np.log(c / n_c) >= toxicity.MIN_ODDS:
            want[w] = np.log(t / n_t) - np.log(c / n_c)
    assert set(model.lexicon) == set(want) and all(abs(model.lexicon[w] - s) < 1e-9 for w, s in want.items())
    for r in toxicity.score(df.limit(40), model).collect():
        n, found = toxicity.scan(r.text, model, toxicity.openings_of(model))
        floor = np.log(max(model.chance * n, 1e-12))
        best = max([model.scale * s - floor for *_, s in found], default=0.0)
        rest = sum(x for *_, s in found if (x := model.scale * s - floor) >= -np.log(toxicity.MAX_EXPECTED))
        z = model.weights[0] * np.log1p(max(best, 0)) + model.weights[1] * np.log1p(rest) + model.weights[2]
        assert abs(r.toxicity - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_statistics_against_loops(docs, prose):
    """Every statistic of whole texts, counted in plain Python."""
    texts = [None, "", " ", "one", "a a a\nb  B!", "## $$$ <<>> http://x.y/z", "Ärger übt\tsich; 12 345", prose(3, 400).upper() + "!!!", "\n\n\n", "x" * 5000, "- item\n- item\n- item", "“quoted” — text…"]
    names = [*quality.NAMES]
    got = {r.doc_id: [r[n] for n in names] for r in docs(list(enumerate(texts))).select("doc_id", *quality.statistics(F.col("text"))).collect()}
    for i, text in enumerate(texts):
        t = text or ""
        w = re.split(r"[ \t\n\x0b\f\r]+", t)
        want = [len(t), len(w), len(t) / len(w), t.count("\n") + 1, len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w)]
        want += [len(regex.findall(p, t)) / (len(t) + 1) for _, p in quality.MARKS]
        assert np.allclose(got[i], want), (text, dict(zip(names, zip(got[i], want))))
