"""Toxicity by maximum-scoring segments.

Words get log-odds of standing in toxic rather than clean texts, with a symmetric Dirichlet prior (PRIOR for each word); those whose
log-odds are beyond MIN_Z deviations, and beyond MIN_ODDS, form the lexicon. So do heads of words, which stand for words that weren't seen often
enough, and all other words share one slightly negative score. A text counts once for a word, however often it says it. By the
extreme-value law of the best segment, one of score S is matched or beaten by chance in a clean text of n words about
K n exp(-lambda S) times; K and the scale lambda are fitted together on the clean learnt texts, by maximum likelihood. A linear scan
(Ruzzo and Tompa) finds all maximal segments; those expected less than MAX_EXPECTED times are passages. A text's score is
logistic in its best segment's and all passages' surplus over chance, calibrated on learnt texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.bpe import pieces
from rasterloom.llm.common import Scratch, beside, fold, small_batches, tidy
from rasterloom.llm.learn import learnt_texts, logistic, training_labels

WORD = re.compile(r"[^\W\d_]+")
PRIOR, MIN_Z, MIN_ODDS, MAX_EXPECTED = 0.5, 3.0, 1.5, 0.05
#: Words that a task sums up before it hands them on.
HELD_WORDS = 200_000
#: Lengths of the heads; a word takes its own score, else that of its longest head in the lexicon.
HEADS = (6, 5, 4)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]  # positive scores; its size is bounded by the learnt sample
    heads: dict[str, float]
    rest: float  # the score of all other words
    chance: float  # K
    scale: float  # lambda
    weights: tuple[float, float, float]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, toxic, clean): texts with the word by label in (text, label); each task sums its own first."""

    def summed(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array([counts[1][w] for w in words], pa.int64()), "clean": pa.array([counts[0][w] for w in words], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label > 0].update(set(WORD.findall((text or "").lower())))
                if len(counts[0]) + len(counts[1]) > HELD_WORDS:
                    yield summed(counts)
                    counts = (Counter(), Counter())
        yield summed(counts)

    parts = texts.mapInArrow(tidy(run), "word string, toxic long, clean long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame) -> tuple[dict[str, float], dict[str, float], float]:
    """The words and heads with significant positive log-odds, and the score of all other words."""
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n_t, n_c = total.toxic or 0, total.clean or 0
    if not n_t or not n_c:
        return {}, {}, 0.0

    def significant(own: DataFrame) -> list:
        own = own.withColumn("t", F.col("toxic") + PRIOR).withColumn("c", F.col("clean") + PRIOR)
        odds = F.log(F.col("t") / (n_t - F.col("t") + 1)) - F.log(F.col("c") / (n_c - F.col("c") + 1))
        ratio = F.log(F.col("t") / n_t) - F.log(F.col("c") / n_c)
        return own.filter((odds / F.sqrt(1 / F.col("t") + 1 / F.col("c")) >= MIN_Z) & (ratio >= MIN_ODDS)).select("word", ratio.alias("score"), "t", "c").collect()

    by_head = [counts.filter(F.length("word") > k).groupBy(F.substring("word", 1, k).alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")) for k in HEADS]
    rows, heads = significant(counts), [r for own in by_head for r in significant(own)]
    if not rows:
        return {}, {}, 0.0
    in_t, in_c = sum(r.t for r in rows) / n_t, sum(r.c for r in rows) / n_c
    return {r.word: r.score for r in rows}, {r.word: r.score for r in heads}, min(math.log(max(1 - in_t, 1e-9) / max(1 - in_c, 1e-9)), -1e-6)


def segments(positions: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a text whose words score `rest` but at positions, in one scan."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    total, at = 0.0, 0
    for p, s in zip(positions, scores, strict=True):
        before = total + rest * (p - at)
        total, at = before + s, p + 1
        begin, left, end, right = p, before, p + 1, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((begin, end, left, right))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, r - l) for b, e, l, r in found]


def score_of(word: str, model: Model) -> float:
    """The word's score if it is above that of the rest, else 0."""
    if word in model.lexicon:
        return model.lexicon[word]
    return next((model.heads[word[:k]] for k in HEADS if len(word) > k and word[:k] in model.heads), 0.0)


def scan(text: str, model: Model, openings: set[str]) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and the maximal segments by word numbers; openings: of all heads, the shortest's length."""
    words, k = WORD.findall(text.lower()), HEADS[-1]
    at = [(i, s) for i, w in enumerate(words) if (w in model.lexicon or w[:k] in openings) and (s := score_of(w, model))]
    return len(words), segments([i for i, _ in at], [s for _, s in at], model.rest)


def openings_of(model: Model) -> set[str]:
    return {h[: HEADS[-1]] for h in model.heads}


#: Texts with a segment that a scale is fitted on at least, and the range that it is searched in.
LEAST_FITTED, SCALES = 20, (0.05, 20.0)


def extreme_value(clean: list[tuple[int, float]]) -> tuple[float, float]:
    """K and lambda from the words and best scores of clean texts, those without any segment as such whose best is below the
    least score seen. With fewer than LEAST_FITTED segments lambda is 1, as of log-likelihood ratios, and K alone is fitted."""
    n, s = (np.array(x, float) for x in zip(*clean, strict=True)) if clean else (np.zeros(0), np.zeros(0))
    seen = s > 0
    if not seen.any():
        return (len(n) / max(n.sum(), 1e-9) if len(n) else 1.0), 1.0
    at = np.where(seen, s, s[seen].min())  # a text without a segment has only not reached this
    m = seen.sum()

    def slope(scale: float) -> float:
        w = n * np.exp(-scale * (at - at.min()))
        return m / scale - s[seen].sum() + m * (w * at).sum() / w.sum()

    scale, (low, high) = 1.0, SCALES
    if m >= LEAST_FITTED:
        for _ in range(60):
            scale = (low + high) / 2
            low, high = (scale, high) if slope(scale) > 0 else (low, scale)
    return m / max((n * np.exp(-scale * at)).sum(), 1e-9), scale


def features(n: int, found: list[tuple[int, int, float]], chance: float, scale: float = 1.0) -> tuple[float, float]:
    """The best segment's surplus over what chance gives in n words, and the sum of all passages' surpluses, as logarithms."""
    floor = math.log(max(chance * n, 1e-12))
    surplus = [scale * s - floor for _, _, s in found if scale * s - floor >= -math.log(MAX_EXPECTED)]
    best = max((scale * s - floor for _, _, s in found), default=0.0)
    return math.log1p(max(best, 0.0)), math.log1p(sum(surplus))


def train(docs: DataFrame, labels: DataFrame, learnt, key: str = "doc_id", text: str = "text", target: str = "toxic") -> Model:
    """Learn from the labelled documents that `learnt` (a Column over labels) admits, a bounded sample of them."""
    chosen = training_labels(labels, target, learnt, key)
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    texts = scratch.save(learnt_texts(docs, chosen, key, text), "learnt")
    counts = scratch.save(count_words(texts), "word-counts", 8)  # read again for each length of heads
    words, heads, rest = lexicon(counts)
    rough = Model(words, heads, rest, 1.0, 1.0, (0.0, 0.0, 0.0))
    openings = openings_of(rough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*scan(t or "", rough, openings), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([[x[2] for x in r[1]] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())})

    seen = texts.mapInArrow(tidy(run), "n long, s array<double>, label int").collect()  # TRAIN_ROWS rows, about, of a few numbers
    scratch.leave()
    y = np.array([r.label > 0 for r in seen], float)
    if not len(y) or y.min() == y.max() or not words:
        share = float(y.mean()) if len(y) else 0.0
        return Model(words, heads, rest, 1.0, 1.0, (0.0, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    clean = [(r.n, max(r.s, default=0.0)) for r in seen if not r.label and r.n]
    chance, scale = extreme_value(clean)
    x = np.array([features(r.n, [(0, 0, s) for s in r.s], chance, scale) for r in seen])
    return Model(words, heads, rest, chance, scale, tuple(logistic(x, y).tolist()))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs with toxicity (0 to 1) and passages: [(begin, end, score, expected)], begin and end by words.

    Null and empty texts have no passages and the score of a text without any; long texts are scanned whole. Repeated rows
    and null ids pass through. Columns named toxicity or passages, in any case, are replaced, all others stay. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon: words significant in TRAIN_ROWS texts
    inner, t, back = beside(docs, text, "toxicity", "passages")
    at = inner.columns.index(t)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        openings = openings_of(m)
        for batch in batches:
            probability, passages = [], []
            texts = batch.column(at).to_pylist()
            for part in pieces(texts):
                for t in texts[part]:
                    n, found = scan(t or "", m, openings)
                    a, b = features(n, found, m.chance, m.scale)
                    w = m.weights
                    probability.append(1 / (1 + math.exp(-max(min(w[0] * a + w[1] * b + w[2], 30), -30))))
                    expected = [(i, j, s, m.chance * n * math.exp(-m.scale * s)) for i, j, s in found]
                    passages.append([dict(zip(("begin", "end", "score", "expected"), x, strict=True)) for x in expected if x[3] <= MAX_EXPECTED])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probability, pa.float64()), pa.array(passages, kind)], [*batch.schema.names, "toxicity", "passages"])

    out = inner.mapInArrow(tidy(run), f"{schema}, toxicity double, passages array<struct<begin:long,end:long,score:double,expected:double>>")
    return out.select(*back, "toxicity", "passages")


def learnt(key: str = "doc_id"):
    """The labels that may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return fold(F.col(key), 5) != 0
