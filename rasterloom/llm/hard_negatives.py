"""Hard negatives by a secondary sort.

Vectors are dealt into stripes, anchors into groups; a task holds one group and lets one stripe stream past it, so rows are moved
once for each group and anchors once for each stripe, whatever the labels. Within a task scores come from products of tiles, and
only what can still count leaves it: first each anchor's best positives, then, once the windows under all its positives are
known, the best few negatives of each window. Both are exact, since what isn't among a stripe's first can't be among the first.

The pairs left are packed into keys (anchor, descending score, positives first, id), repartitioned by anchor and sorted within
partitions. One pass over that order opens an anchor's windows at its positives and emits negatives as they come by; neither an
anchor's pairs nor anything else but its few open windows is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, per, tidy

#: Bytes of an anchors' group in double precision, of a stripe, rows of a stripe where there are few, and stripes of such.
GROUP_BYTES, STRIPE_BYTES, STRIPE_ROWS, FEW_STRIPES = 48 << 20, 256 << 20, 1024, 64
#: Rows of an anchors' and of a candidates' tile.
TILE_ANCHORS, TILE_ROWS = 1024, 4096
#: Integer components beyond this can't be promised to give scores that fit a long.
MOST = 2.0**31
LEAST = np.iinfo(np.int64).min


def usable(vector: Column, scale: float) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers: in doubles while no sum leaves their range, else in longs."""
    reach = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))
    if reach < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def share(score: np.ndarray, hundredths: int) -> np.ndarray:
    """floor(score * hundredths / 100), without leaving the longs."""
    return score // 100 * hundredths + score % 100 * hundredths // 100


class Best:
    """The first k candidates (highest score, then smallest id) of each of n searches."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), LEAST), np.zeros((n, k), np.int64), np.full((n, k), -1)

    def see(self, searches: np.ndarray, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores of candidates, in ascending order of their ids, by search; those not valid are passed over."""
        some = np.flatnonzero((valid & (scores >= self.score[searches, -1:])).any(axis=1))
        if not len(some):
            return
        at, m = searches[some], scores.shape[1]
        masked = np.where(valid[some], scores[some], LEAST)
        if m > self.k:
            if np.abs(scores).max() < 2**50:  # one number orders by score and place; no ties are left
                keys = np.where(valid[some], masked * TILE_ROWS - np.arange(m), LEAST)
                top = np.argpartition(keys, m - self.k, axis=1)[:, m - self.k :]
            else:
                top = np.argsort(np.where(masked == LEAST, np.iinfo(np.int64).max, -masked), axis=1, kind="stable")[:, : self.k]
        else:
            top = np.broadcast_to(np.arange(m), masked.shape)
        found = np.take_along_axis(masked, top, axis=1)
        score = np.concatenate([self.score[at], found], axis=1)
        id_ = np.concatenate([self.id[at], ids[top]], axis=1)
        row = np.concatenate([self.row[at], np.where(found == LEAST, -1, rows[top])], axis=1)
        order = np.lexsort((row, id_, np.where(row < 0, np.iinfo(np.int64).max, -score)), axis=-1)[:, : self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, axis=1) for x in (score, id_, row))


class Group:
    """The anchors of one group and width, in one task: each batch of candidates is seen once."""

    def __init__(self, parts: list[dict], scale: float, positives: int, negatives: int | None):
        self.row, self.id, self.label = (np.concatenate([p[c] for p in parts]) for c in ("row", "id", "label"))
        self.v = np.floor(scale * np.concatenate([p["v"] for p in parts]))
        self.scale, n = scale, len(self.row)
        if negatives is None:
            self.windows, self.best = None, [Best(n, positives)]
        else:
            self.windows = np.concatenate([p["windows"] for p in parts])  # positives' scores, LEAST where there are fewer
            self.best = [Best(n, negatives) for _ in range(positives)]

    def see(self, part: dict, low: int, high: int) -> None:
        order = np.argsort(part["id"], kind="stable")
        row, id_, label, v = (part[c][order] for c in ("row", "id", "label", "v"))
        v = np.floor(self.scale * v)
        for i in range(0, len(self.row), TILE_ANCHORS):
            own = slice(i, min(i + TILE_ANCHORS, len(self.row)))
            for j in range(0, len(row), TILE_ROWS):
                c = slice(j, j + TILE_ROWS)
                self.tile(np.arange(own.start, own.stop), row[c], id_[c], label[c], v[c], low, high)

    def tile(self, at, row, id_, label, v, low, high) -> None:
        if self.windows is None:
            for kind in np.intersect1d(self.label[at], label):  # products of the same label only
                a, c = at[self.label[at] == kind], label == kind
                self.best[0].see(a, products(self.v[a], v[c]), self.id[a][:, None] != id_[c][None, :], id_[c], row[c])
            return
        scores = products(self.v[at], v)
        other = self.label[at][:, None] != label[None, :]
        for w, best in enumerate(self.best):
            positive = self.windows[at, w]
            there = positive >= 0  # the window of a negative score, as that of none, is empty
            lowest = np.where(there, -share(positive, -low), 1)
            highest = np.where(there, share(positive, high), 0)
            best.see(at, scores, other & (scores >= lowest[:, None]) & (scores <= highest[:, None]), id_, row)

    def found(self) -> pa.RecordBatch:
        anchor = np.concatenate([np.repeat(self.row, b.k) for b in self.best])
        score, id_, row = (np.concatenate([getattr(b, c).ravel() for b in self.best]) for c in ("score", "id", "row"))
        there = row >= 0
        anchor, score, id_, row = anchor[there], score[there], id_[there], row[there]
        _, first = np.unique(np.stack([anchor, row]), axis=1, return_index=True)  # windows overlap
        return pa.RecordBatch.from_pydict({"anchor": pa.array(anchor[first]), "score": pa.array(score[first]), "id": pa.array(id_[first])})


def pass_by(rows: DataFrame, anchors: DataFrame, stripes: int, groups: int, scale: float, positives: int, negatives: int | None, low: int, high: int) -> DataFrame:
    """(anchor, score, id) of what each task leaves: each anchor's best positives, or where negatives are asked for the best of
    these in each window. anchors have group and, in the second case, windows."""
    none = F.lit(None).cast("array<bigint>")
    deal = F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int").alias("stripe")
    passing = rows.select(deal, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("passing"), "row", "id", "label", "v", none.alias("windows"))
    held = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), "group", F.lit(False).alias("passing"), "row", "id", "label", "v", (none if negatives is None else F.col("windows")).alias("windows"))
    both = held.unionByName(passing).repartition(2 * stripes * groups, "stripe", "group").sortWithinPartitions("stripe", "group", "passing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, {}, {}
        for batch in batches:
            of = np.stack([batch.column(c).to_numpy() for c in ("stripe", "group")])
            going = batch.column("passing").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0) | (going[1:] != going[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if i == j:
                    continue
                if (here := (int(of[0, i]), int(of[1, i]))) != at:
                    yield from (g.found() for g in held.values())
                    at, parts, held = here, {}, {}
                for width, part in by_width(batch.slice(i, j - i), positives if negatives is not None and not going[i] else 0):
                    if not going[i]:
                        parts.setdefault(width, []).append(part)
                    elif width in parts or width in held:
                        if width not in held:
                            held[width] = Group(parts.pop(width), scale, positives, negatives)
                        held[width].see(part, low, high)
        yield from (g.found() for g in held.values())

    return both.mapInArrow(tidy(run), "anchor long, score long, id long")


def by_width(batch: pa.RecordBatch, windows: int) -> Iterator[tuple[int, dict]]:
    """The rows of a batch as arrays, by the number of their vectors' components."""
    vectors = batch.column("v")
    widths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy().astype(np.float64)
    begins = np.cumsum(np.r_[0, widths])[:-1]
    columns = {c: batch.column(c).to_numpy() for c in ("row", "id", "label")}
    for w in np.unique(widths):
        some = widths == w
        part = {c: x[some] for c, x in columns.items()} | {"v": flat[begins[some][:, None] + np.arange(w)]}
        if windows:
            wide = np.full((len(some), windows), LEAST)
            for i, scores in enumerate(batch.column("windows").to_pylist()):
                wide[i, : len(scores)] = scores
            part["windows"] = wide[some]
        yield int(w), part


def emit(positives: DataFrame, negatives: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """(anchor, positive_id, rank, negative_id, positive_score, negative_score) from pairs (anchor, score, id), by the secondary sort."""
    pairs = positives.withColumn("negative", F.lit(False)).unionByName(negatives.withColumn("negative", F.lit(True)))
    key = [F.col("anchor"), F.col("score").desc(), F.col("negative"), F.col("id")]
    sorted_ = pairs.repartition("anchor").sortWithinPartitions(*key)
    names = ("anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, windows = None, []  # of the anchor that passes by: positive's id, its score, negatives so far
        for batch in batches:
            out = [[] for _ in names]
            for anchor, score, id_, negative in zip(*(batch.column(c).to_pylist() for c in ("anchor", "score", "id", "negative")), strict=True):
                if anchor != at:
                    at, windows = anchor, []
                if not negative:
                    windows.append([id_, score, 0])
                    continue
                for window in windows:
                    positive_id, positive, seen = window
                    if seen < count and low * positive <= 100 * score <= high * positive:
                        window[2] = seen + 1
                        for column, value in zip(out, (anchor, positive_id, seen + 1, id_, positive, score), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "rank" else pa.int64()) for n, x in zip(names, out, strict=True)], names=list(names))

    return sorted_.mapInArrow(tidy(run), "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    Anchors are the rows where is_anchor holds (by default those whose id is divisible by 50). Components become
    floor(scale * x), a score is the integer inner product with the anchor; higher ones come first, ties by the smaller id. An
    anchor's positives are its first rows of the same label; for each of them the first negatives come whose scores lie between
    low and high hundredths of the positive's. Fewer rows there give fewer rows here, an empty table none.

    Rows take no part that have a null id (none could name them), a null label, a null vector, or a component that is null, not
    finite or 2^31 and more once scaled (scores wouldn't fit a long). Zero vectors take part. Only vectors with the same number
    of components are compared; very long ones only make stripes of fewer rows. Of repeated rows (same id, label and vector) one
    counts; rows with the anchor's own id aren't among its others; rows with one id but other labels or vectors are all
    candidates, and as anchors each asks by itself. Other columns, whatever their names, aren't read.
    """
    anchors = F.col(key) % 50 == 0 if is_anchor is None else is_anchor
    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    good = slim.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"), scale))
    scratch = Scratch(vectors.sparkSession)
    once = good.groupBy("id", "label", "v").agg(F.max("asks").alias("asks"))
    rows = scratch.save(once.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = F.size("v").cast("long") * 8 + 40
    told = rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(F.when(F.col("asks"), size)).alias("asking")).first()
    stripes = max(per(told.bytes or 0, STRIPE_BYTES), min(FEW_STRIPES, per(told.n, STRIPE_ROWS)))
    groups = per(told.asking or 0, GROUP_BYTES)
    asking = rows.filter("asks").select("row", "id", "label", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"))
    first = pass_by(rows, asking, stripes, groups, scale, positives, None, low, high)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    kept = scratch.save(first.withColumn("place", place).filter(F.col("place") <= positives).drop("place"), "positives")
    windows = kept.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("windows"))  # a few each
    narrowed = asking.join(windows, asking.row == windows.anchor).drop("anchor")
    second = pass_by(rows, narrowed, stripes, groups, scale, positives, negatives, low, high)
    found = emit(kept, second, negatives, low, high)
    ids = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
