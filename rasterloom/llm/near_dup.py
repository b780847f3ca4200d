"""Near duplicates by MinHash, with odd sketches before the exact check.

Words and five-word shingles are taken from whole texts, however long. Equal word sequences form one class, which is hashed
once. Each class gets BANDS x ROWS MinHash samples; equal bands put classes into a bucket. The samples are also folded into an
odd sketch, a parity bitmap of SKETCH_BITS: the population count of two sketches' XOR tells how many samples differ, which is
precise at high similarities, so pairs that can't reach the threshold are dropped before their full sets are compared.

Buckets aren't expanded into all pairs. Every class is compared with the hub of its bucket, the class whose buckets are
largest, and the confirmed links' components are found. Buckets that then hold several components are open. Classes that open
buckets connect form a group, and within it only differences from a centre count: the centre H is what more than half of the group's
sets have. Let D(i) be what is in just one of H and i's set. The intersection of i and j has
|H| - |H minus i| - |H minus j| + |D(i) and D(j)| members, whatever H is, so the threshold becomes a bound on common differences:

    2 (100 + p) |D(i) and D(j)| >= beta(i) + beta(j),    beta(i) = 2 p |i| + 2 (100 + p) |H minus i| - (100 + p) |H|

Let s be the class of the group's least beta. A class with beta(i) <= -beta(s) is linked with s ("near"); every other ("far") shares
a difference with all that it is linked with. Differences that one class alone has are of no use; classes of equal sizes and equal
other differences agree in all links, so one of them stands for all. These representatives are cut into levels by beta. Between two levels
the bound needs T common differences at least, and with a common order of all differences the first common one is among
the first d - T + 1 of either side's d, and the last one among the last d - T + 1: a prefix filter. The order is by rarity, roughly,
then by the place in the texts, so that the two stem from different edits. Representatives meet under their first common
difference, and where too many would, under the first and the last. Keys that many share are salted. What meets is compared by
sketches, then by its differences exactly. All tables stay distributed; each step is written to the shared folder.

The buckets miss a pair at the threshold with a chance of (1 - 0.75^5)^40, about 2 in 100,000, and less above it. Classes are
known by 64 bits of a digest: among n different texts two share one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.bpe import pieces
from rasterloom.llm.common import Scratch, per, small_batches, tidy

SHINGLE = 5
BANDS, ROWS, SKETCH_BITS = 40, 5, 1024
#: Bits of the odd sketch of whole sets that classes in open buckets get besides.
SET_BITS = 2048
#: Deviations beyond the expected count of differing bits at which a pair is dropped.
SIGMAS = 4.5
#: Texts hashed at a time, in characters: the arrays stay in a core's cache.
HASH_CHARS = 400_000
#: Rows of ids that may be broadcast (32 bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 500_000
#: Classes under one key of the prefix filter that one task compares with.
SALT_ROWS = 2_000
#: Comparisons for each entry under a key of one difference, beyond which the last common difference joins the key.
MATCHES = 8
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Shingle hashes and MinHash samples, with constants from a fixed seed."""

    def __init__(self, seed: int = 20240601):
        draw = np.random.default_rng(seed)
        self.letter = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        n = BANDS * ROWS
        self.times = draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = draw.integers(0, 1 << 32, n, np.uint32)
        self.fold = draw.integers(0, 1 << 63, n, np.uint64)
        self.row = draw.integers(0, 1 << 62, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = draw.integers(0, 1 << 63, BANDS, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of texts (not empty, words parted by single blanks), and how many each text has."""
        data = np.frombuffer(b" ".join(texts), np.uint8)
        self.reach(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.powers[: len(data)], out=total[1:])
        blanks = np.flatnonzero(data == 32)
        starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(data)]
        words = np.array([t.count(b" ") + 1 for t in texts])
        n = np.maximum(words - SHINGLE + 1, 1)
        first = np.repeat(np.r_[0, np.cumsum(words)[:-1]], n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        last = first + np.repeat(np.minimum(words, SHINGLE) - 1, n)
        begin = starts[first]
        return mix((total[ends[last]] - total[begin]) * self.inverses[begin]), n

    def samples(self, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """MinHash samples, one row for each of BANDS x ROWS hash functions."""
        x, at = (hashes >> np.uint64(32)).astype(np.uint32), np.r_[0, np.cumsum(n)[:-1]]
        out, y = np.empty((len(self.times), len(n)), np.uint32), np.empty_like(x)
        for j in range(len(self.times)):
            np.multiply(x, self.times[j], out=y)
            np.add(y, self.plus[j], out=y)
            out[j] = np.minimum.reduceat(y, at)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        parts = samples.reshape(BANDS, ROWS, -1).astype(np.uint64)
        return mix((parts * self.row[None, :, None]).sum(axis=1) + self.band[:, None]).view(np.int64).T

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        docs = samples.shape[1]
        at = mix(samples.astype(np.uint64) + self.fold[:, None]).ravel()
        return parities(at, np.tile(np.arange(docs), len(samples)), docs, SKETCH_BITS)


def parities(hashes: np.ndarray, of: np.ndarray, docs: int, bits: int) -> np.ndarray:
    """A bitmap for each of docs: bit b tells whether an odd number of its hashes begin with b."""
    at = (hashes >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    odd = np.bincount(at + of * bits, minlength=docs * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(docs, -1)


_HASHER: list[Hasher] = []


def hasher() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher())
    return _HASHER[0]


def normal(text: str | None) -> bytes:
    """Words parted by single blanks, A-Z lower-cased; other letters stay."""
    return b" ".join((text or "").encode().lower().split())


def node_of(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def lists(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))


def signatures(docs: DataFrame, key: str, text: str, carry: bool = False) -> DataFrame:
    """key, node (a digest of the words; null without words), n_shingles, bands and sketch of every row; on request, the
    text's digest."""
    more = ["digest"] if carry else []
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(F.xxhash64(text).alias(c) for c in more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in pieces(texts, HASH_CHARS):
                bodies = [normal(t) for t in texts[part]]
                full = [b for b in bodies if b]
                node = [node_of(b) if b else None for b in bodies]
                size, where = np.zeros(len(bodies), np.int64), np.flatnonzero([bool(b) for b in bodies])
                bands, sketch = np.zeros((len(bodies), BANDS), np.int64), np.zeros((len(bodies), SKETCH_BITS // 64), np.int64)
                if full:
                    hashes, n = h.shingles(full)
                    size[where] = [len(np.unique(x)) for x in np.split(hashes, np.cumsum(n)[:-1])]
                    samples = h.samples(hashes, n)
                    bands[where], sketch[where] = h.bands(samples), h.odd_sketch(samples)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key")[part.start : part.stop], pa.array(node, pa.int64()), pa.array(size), lists(bands), lists(sketch), *(batch.column(c)[part.start : part.stop] for c in more)],
                    ["key", "node", "n_shingles", "bands", "sketch", *more],
                )

    return slim.mapInArrow(tidy(run), "key long, node long, n_shingles long, bands array<long>, sketch array<long>" + "".join(f", {c} long" for c in more))


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles, parity) of the wanted nodes, from the rows that stand for them: wanted has node and rep. Shingles come
    in the order of their first places; parity is the odd sketch of the whole set."""
    small = wanted.count() <= BROADCAST_ROWS
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    own = slim.join(F.broadcast(wanted) if small else wanted, F.col("key").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for batch in batches:
            nodes, texts = batch.column("node").to_pylist(), batch.column("text").to_pylist()
            for part in pieces(texts, HASH_CHARS):
                bodies = [(node, b) for node, t in zip(nodes[part], texts[part], strict=True) if (b := normal(t)) and node_of(b) == node]
                if bodies:
                    hashes, n = h.shingles([b for _, b in bodies])
                    sets = [x[np.sort(np.unique(x, return_index=True)[1])] for x in np.split(hashes, np.cumsum(n)[:-1])]
                    sizes, every = np.array([len(x) for x in sets]), np.concatenate(sets)
                    flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(every.view(np.int64)))
                    parity = lists(parities(mix(every), np.repeat(np.arange(len(sets)), sizes), len(sets), SET_BITS))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in bodies], pa.int64()), flat, parity], ["node", "shingles", "parity"])

    return own.mapInArrow(tidy(run), "node long, shingles array<long>, parity array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity"))


def sketch_limit(similarity: float, k: int = BANDS * ROWS, n: int = SKETCH_BITS) -> int:
    """The count of differing bits, of n from k samples, beyond which a pair is below the similarity, but for SIGMAS deviations."""
    differ, spread = 2 * k * (1 - similarity), 2 * math.sqrt(k * similarity * (1 - similarity))
    bits, slope = n / 2 * (1 - math.exp(-2 * differ / n)), math.exp(-2 * differ / n)
    noise = n / 4 * (1 - math.exp(-4 * differ / n)) - slope**2 * differ  # of the folding, for a given number of samples that differ
    return math.ceil(bits + SIGMAS * math.sqrt((slope * spread) ** 2 + noise))


def bits_apart(a: str, b: str, bits: int) -> Column:
    """In how many bits two bitmaps differ."""
    return reduce(lambda p, q: p + q, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sketched classes can be linked: by their sizes, then by the odd sketches."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (bits_apart(f"{a}.sketch", f"{b}.sketch", SKETCH_BITS) <= sketch_limit(percent / 100))


def sets_may_link(a: str, b: str, percent: int) -> Column:
    """The same by the odd sketches of whole sets. Linked sets differ in `most` members at most, and their sketches in no
    more bits; as members fall on the same bits, in fewer where many differ, but for SIGMAS deviations."""
    most = (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * ((100 - percent) / (100 + percent))
    left = F.exp(-4 * most / SET_BITS)
    spread = F.greatest(SET_BITS / 4 * (1 - left) - left * most, F.lit(0.0))
    limit = SET_BITS / 2 * (1 - F.exp(-2 * most / SET_BITS)) + SIGMAS * F.sqrt(spread) + 1
    return bits_apart(f"{a}.parity", f"{b}.parity", SET_BITS) <= F.least(most, limit)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return joined.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def groups_of(edges: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    """(node, grp, size, salt) for each node of the edges (a, b): its connected group, and one of the group's salts."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    grouped = nodes.join(components(edges, scratch, files), "node", "left").select("node", F.coalesce("component", "node").alias("grp"))
    grouped = scratch.save(grouped, "grouped", files)
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    return scratch.save(met(grouped, sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("node"), salts("size")).cast("int")), "groups", files)


def salts(rows: str) -> Column:
    return F.ceil(F.col(rows) / SALT_ROWS).cast("int")


def met(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a table that has one row for each key; few keys are broadcast, more shuffle."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small, key)


def differences(nodes: DataFrame, sets: DataFrame, sketched: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For nodes (node, grp, size, salt, component): (grp, node, component, n, beta, sketch, parity, d), d its differences from
    the group's centre; and (grp, g, f, at) for the differences that several classes have, with their count and mean place."""
    each = nodes.select("node", "grp", "size").join(sets.select("node", "shingles"), "node").select("grp", "size", F.posexplode("shingles").alias("at", "g"))
    stats = scratch.save(each.groupBy("grp", "size", "g").agg(F.count("*").alias("f"), F.avg("at").alias("at")).filter("f > 1"), "stats")
    inside = 2 * F.col("f") > F.col("size")
    centres = stats.filter(inside).groupBy("grp", "size").agg(F.collect_list("g").alias("h"))
    centres = centres.select("grp", "h", F.explode(F.sequence(F.lit(0), salts("size") - 1)).alias("salt"))
    own = nodes.join(sets, "node").join(sketched.select("node", "sketch"), "node").join(centres, ["grp", "salt"], "left")
    own = own.withColumn("h", F.coalesce("h", F.array().cast("array<long>"))).withColumn("lacked", F.array_except("h", "shingles"))
    n, lacked, of_h = F.size("shingles").cast("long"), F.size("lacked").cast("long"), F.size("h").cast("long")
    beta = 2 * percent * n + 2 * (100 + percent) * lacked - (100 + percent) * of_h
    found = own.select("grp", "node", "component", n.alias("n"), beta.alias("beta"), "sketch", "parity", F.concat(F.array_except("shingles", "h"), "lacked").alias("d"))
    often = stats.select("grp", "g", F.when(inside, F.col("size") - F.col("f")).otherwise(F.col("f")).alias("f"), "at").filter("f > 1")
    return scratch.save(found, "differences"), often


def representatives(found: DataFrame, often: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of differences: members (grp, rep, node), and for each rep (grp, rep, n_shingles, beta, one, rows, sketch, parity, own): own are
    its differences that others have too, in the common order; one is the component of the rows it stands for if they have
    but one."""
    each = found.select("grp", "node", F.explode("d").alias("g")).join(often, ["grp", "g"])
    rank = F.struct(F.floor(F.log2("f") / 2).alias("scarce"), "at", F.xxhash64("g").alias("mixed"), "g")
    own = each.groupBy("grp", "node").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda d: d.g).alias("own"))
    same = ["grp", "n", "beta", "digest"]
    known = found.drop("d").join(own, ["grp", "node"]).withColumn("digest", F.xxhash64("own"))
    known = scratch.save(known, "known")
    reps = known.groupBy(*same).agg(F.min("node").alias("rep"), F.count("*").alias("rows"), F.min("component").alias("x"), F.max("component").alias("y"))
    reps = scratch.save(reps, "reps")
    members = known.select("node", *same).join(reps.filter("rows > 1").select("rep", *same), same).filter("node <> rep").select("grp", "rep", "node")
    one = known.select(F.col("node").alias("rep"), "grp", "own", "sketch", "parity").join(reps, ["grp", "rep"])
    return members, one.select("grp", "rep", F.col("n").alias("n_shingles"), "beta", F.when(F.col("x") == F.col("y"), F.col("x")).alias("one"), "rows", "sketch", "parity", "own")


def met_under_keys(reps: DataFrame, unit: int, scratch: Scratch) -> DataFrame:
    """The pairs (grp, a, b) of representatives with a level (0: near) that may share as many differences as the bound asks for."""
    levels = reps.groupBy("grp", "level").agg(F.min("beta").alias("low"), F.max(F.size("own")).alias("most"))
    levels = scratch.save(levels.groupBy("grp").agg(F.collect_list(F.struct("level", "low", "most")).alias("levels")), "levels")
    needed = F.greatest(F.lit(1), F.ceil((F.col("beta") + F.col("other.low")) / unit)).cast("int")
    d = F.size("own")
    rows = met(reps.select("grp", "rep", "level", "beta", "one", "own"), levels, "grp").withColumn("other", F.explode("levels")).drop("levels")
    rows = rows.filter("level > 0 or other.level > 0").withColumn("needed", needed).filter(F.col("needed") <= F.least(d, F.col("other.most")))
    slim = ["grp", F.least("level", "other.level").alias("lo"), F.greatest("level", "other.level").alias("hi"), "level", "rep", "beta", d.alias("d"), "one"]
    prefix = F.transform(F.slice("own", F.lit(1), d - F.col("needed") + 1), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    # what may be the last common difference of those that begin with the i-th: for more than one needed, not this itself
    begin = F.greatest(F.col("needed"), F.col("key.i") + F.when(F.col("needed") > 1, 2).otherwise(1))
    rows = rows.withColumn("key", F.explode(prefix))
    entries = scratch.save(rows.select(*slim, "needed", F.col("key.g").alias("g"), F.slice("own", begin, F.greatest(d - begin + 1, F.lit(0))).alias("ends")), "entries")
    key = ["grp", "lo", "hi", "g"]
    sides = [F.count_if(F.col("level") == F.col(c)).alias(f"n_{c}") for c in ("lo", "hi")]
    used = F.when(F.col("lo") == F.col("hi"), F.col("n_hi") > 1).otherwise((F.col("n_lo") > 0) & (F.col("n_hi") > 0))
    split = (F.col("least") > 1) & (F.col("n_lo") * F.col("n_hi") > MATCHES * (F.col("n_lo") + F.col("n_hi")))
    keys = entries.groupBy(*key).agg(*sides, F.min("needed").alias("least")).filter(used).select(*key, split.alias("split"))
    ends = F.when(F.col("split"), F.col("ends")).otherwise(F.array(F.lit(0).cast("long")))
    keyed = scratch.save(entries.join(keys, key).withColumn("end", F.explode(ends)).drop("ends", "split", "needed"), "keyed")
    key += ["end"]
    keys = scratch.save(keyed.groupBy(*key).agg(*sides).filter(used), "keys")
    keyed = keyed.join(keys.select(*key, salts("n_hi").alias("salts")), key)

    def side(level: str, name: str, salt: Column) -> DataFrame:
        return keyed.filter(F.col("level") == F.col(level)).select(*key, salt.alias("salt"), F.struct("rep", "beta", "d", "one").alias(name))

    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    can = ((F.col("lo") < F.col("hi")) | (p("rep") < q("rep"))) & ~F.coalesce(p("one") == q("one"), F.lit(False)) & (unit * F.least(p("d"), q("d")) >= p("beta") + q("beta"))
    pairs = side("lo", "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(side("hi", "q", F.pmod(F.xxhash64("rep", F.lit(3)), "salts").cast("int")), [*key, "salt"])
    return pairs.filter(can).select("grp", F.least(p("rep"), q("rep")).alias("a"), F.greatest(p("rep"), q("rep")).alias("b")).distinct()


def by_differences(found: DataFrame, often: DataFrame, percent: int, scratch: Scratch, files: int) -> DataFrame:
    """The links (a, b) within groups, but such as join what is in one component already: for each class at least one with
    every component that it is linked with."""
    unit = 2 * (100 + percent)
    stars = found.groupBy("grp").agg(F.min(F.struct("beta", "node", "component")).alias("s"))
    stars = scratch.save(stars.select("grp", F.col("s.node").alias("star"), F.col("s.beta").alias("low"), F.col("s.component").alias("of_star")), "stars")
    found = met(found, stars, "grp").withColumn("near", F.col("beta") <= -F.col("low"))
    near = found.filter("near and node <> star").select(F.col("star").alias("a"), F.col("node").alias("b"))
    known = found.withColumn("component", F.when(F.col("near"), F.col("of_star")).otherwise(F.col("component")))
    members, reps = representatives(known.drop("star", "low", "of_star", "near"), often, scratch)
    above = (F.col("beta") - F.col("low")) / unit
    level = F.when(F.col("beta") <= -F.col("low"), 0).otherwise(1 + F.floor(2 * F.log2(1 + above)).cast("int"))
    reps = scratch.save(met(reps, stars.select("grp", "low"), "grp").withColumn("level", level).drop("low"), "representatives")
    members = scratch.save(members, "of-representatives")
    pairs = scratch.save(met_under_keys(reps, unit, scratch), "met", files)
    a, b = (reps.select("grp", F.col("rep").alias(x), F.struct("n_shingles", "sketch", "parity", "beta", "own").alias(f"s{x}")) for x in "ab")
    likely = pairs.join(a, ["grp", "a"]).join(b, ["grp", "b"]).filter(may_link("sa", "sb", percent) & sets_may_link("sa", "sb", percent))
    exact = unit * F.size(F.array_intersect("sa.own", "sb.own")).cast("long") >= F.col("sa.beta") + F.col("sb.beta")
    links = scratch.save(likely.filter(exact).select("grp", "a", "b"), "links", files)
    partner = links.union(links.select("grp", "b", "a")).groupBy("grp", F.col("a").alias("rep")).agg(F.min("b").alias("b"))
    alike = reps.filter((F.col("rows") > 1) & (unit * F.size("own").cast("long") >= 2 * F.col("beta"))).select("grp", "rep")
    of_members = members.join(partner, ["grp", "rep"]).select(F.col("node").alias("a"), "b")
    return near.union(links.select("a", "b")).union(of_members).union(members.join(alike, ["grp", "rep"]).select(F.col("rep").alias("a"), F.col("node").alias("b")))


def components(edges: DataFrame, scratch: Scratch, files: int | None = None) -> DataFrame:
    """(node, component): the least node of each node's component, by alternating large and small stars."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", files)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", files)
        scratch.drop(now)
        now = then


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, carry: bool = False) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links, itself included) and kept, for each row.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. A null or empty text, or one of white
    space only, has an empty set, is linked with nothing, and is its own component. Repeated rows are equal texts: each is
    returned, all are in one component, and a repeated smallest key is kept as often. A null key never is a component's
    smallest; in a component of null keys alone the id is null and all rows are kept. Very long texts are compared whole. Other
    columns aren't read. An empty table gives an empty result. Keys are integers. carry adds digest (of the text) and component, which tells components
    of the same smallest key apart and is null for rows without words.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(signatures(docs, key, text, carry), "signatures")
    full = rows.filter(F.col("node").isNotNull())
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    classes = scratch.save(full.groupBy("node").agg(F.min("key").alias("rep"), *first), "classes", per(rows.count(), 40_000))
    n = classes.count()
    few, many = per(n, 500_000), per(n, 100_000)  # files of small tables, and of those with several rows for a class
    flat = classes.select("node", F.posexplode("bands").alias("band", "bucket")).select("node", F.xxhash64("band", "bucket").alias("bucket"))
    shared = scratch.save(flat.join(flat.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"), "shared", many)
    # the hub is the class whose buckets are largest: nearest to what its bucket has in common
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", F.bitwise_not("node").alias("other"))).alias("top"))
    members = scratch.save(shared.select("bucket", "node").join(hubs.select("bucket", F.bitwise_not("top.other").alias("hub")), "bucket"), "members", many)
    scratch.drop(shared)

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        wanted = scratch.save(nodes.distinct().join(classes.select("node", "rep"), "node"), "wanted", few)
        return scratch.save(shingle_sets(docs, wanted, key, text), name)

    def both(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.col(a).alias("node")).union(pairs.select(b))

    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    a, b = (classes.select(F.col("node").alias(x), F.struct("n_shingles", "sketch").alias(f"s{x}")) for x in "ab")
    likely = scratch.save(stars.join(b, "b").join(a, "a").filter(may_link("sa", "sb", percent)).select("a", "b"), "likely", few)
    sets = sets_of(both(likely, "a", "b"), "sets")
    links = scratch.save(confirmed(likely, sets, percent), "links", few)
    scratch.drop(sets)
    found = components(links, scratch, few)

    own = members.join(found, "node", "left").select("bucket", "hub", "node", F.coalesce("component", "node").alias("component"))
    apart = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    open_stars = own.join(apart, "bucket", "left_semi").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    nodes = groups_of(scratch.save(open_stars, "open", few), scratch, few)
    sets = sets_of(nodes.select("node"), "open-sets")
    nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    unlike, often = differences(nodes, sets, classes, percent, scratch)
    scratch.drop(sets)
    links = links.union(by_differences(unlike, often, percent, scratch, few))
    found = components(links, scratch, few)

    labelled = classes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = scratch.save(labelled.join(least, "component").select("node", "component_id", "component"), "components", few)
    scratch.leave(rows, of_node)
    out = rows.select("key", "n_shingles", "node", *(["digest"] if carry else [])).join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), *(["digest", "component"] if carry else []))
