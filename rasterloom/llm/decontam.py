"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's words are cut into windows of WINDOW words; a shorter item is one window. A window occurs in a document only if
all its shingles do, so joining one of them finds every occurrence: the necessary prefix at containment 1 is a single
token. The shingles are ordered by their counts in the whole corpus and each window joins on its rarest. A match at some
place fixes where the window would begin; it must fit into the document (position and length bounds), and then the words
themselves are compared.

Documents are first met with hashes alone, BLOCK_HASHES of them at once; only the few places that are left, each with the words
around it, are joined with the windows, by a broadcast if these are few and else by a shuffle. Windows are known by 64 bits of a
hash: among n different ones two share one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, per

WINDOW, SHINGLE = 13, 5
#: Hashes that are broadcast at once (some 40 bytes each), windows that may be (some 300), and rows of documents with hits.
BLOCK_HASHES, BROADCAST_WINDOWS, BROADCAST_ROWS = 2_000_000, 200_000, 100_000
#: What parts words, beside A-Z that are lower-cased first.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    plain = F.translate(text, UPPER + "".join(map(chr, SEPARATORS)), LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def shingles(of: Column, length: int) -> Column:
    """All runs of `length` words, as an array of structs."""
    many = F.greatest(F.size(of) - (length - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(of, k + 1, many).alias(f"w{k}") for k in range(length)))


def hashed(shingle: str, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.col(f"{shingle}.w{k}") for k in range(length)))


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """(id, window, item) rows: window is an array of words, id its hash."""
    own = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    each = own.select("item", F.explode(F.transform(begins, lambda i: F.slice("w", i, WINDOW))).alias("window"))
    return each.select(F.xxhash64("window").alias("id"), "window", "item").distinct()


def places(rows: DataFrame, tokens: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """rows' columns, `at` (from 0) and hash for each place where one of tokens (hash, length; distinct) stands."""
    parts = []
    for b in range(blocks):
        own = tokens if blocks == 1 else tokens.filter(F.pmod("hash", F.lit(blocks)) == b)
        for n in lengths:
            placed = rows.select("*", F.posexplode(shingles(F.col("w"), n)).alias("at", "s"))
            keyed = placed.select(*rows.columns, "at", hashed("s", n).alias("hash"))
            parts.append(keyed.join(F.broadcast(own.filter(F.col("length") == n).select("hash")), "hash", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit (words inside any occurrence of a window), items (sorted ids, as text, of the items with occurring
    windows), contaminated (n_hit > 0 and 20 * n_hit >= n_words) and digest (of the text, to tell rows with one key apart).

    One row for each document. Null and empty texts have no words and are never contaminated; very long texts are searched
    whole. Benchmark rows with a null id or without words are ignored, repeated ones count once. Of shingles that are
    equally rare the one with the smaller hash is joined. Rows that share a key are judged apart, by their texts; a null key
    is a key like others. With an empty benchmark nothing is hit. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    pairs = scratch.save(item_windows(items, item, item_text), "item-windows")
    windows = scratch.save(pairs.groupBy("id").agg(F.first("window").alias("window")), "windows")
    length = F.least(F.size("window"), F.lit(SHINGLE))
    lengths = sorted(r.n for r in windows.select(length.alias("n")).distinct().collect())  # SHINGLE values at most
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = named.select("key", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    sizes = named.select("key", F.xxhash64("text").alias("digest"), F.greatest(F.coalesce(F.size(words(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("n_words"))
    if not lengths:
        return sizes.select(F.col("key").alias(key), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"), "digest")

    by_length = [windows.filter(length == n).select("id", F.lit(n).alias("length"), F.posexplode(shingles(F.col("window"), n)).alias("offset", "s")).select("id", "length", "offset", hashed("s", n).alias("hash")) for n in lengths]
    n_windows = windows.count()
    tokens = scratch.save(reduce(DataFrame.unionByName, by_length), "tokens", per(n_windows, 100_000))
    distinct = scratch.save(tokens.select("hash", "length").distinct(), "hashes", per(n_windows, 500_000))
    seen = places(rows.select("w"), distinct, lengths, per(distinct.count(), BLOCK_HASHES))
    counts = scratch.save(seen.groupBy("hash").agg(F.count("*").alias("n")), "counts", per(n_windows, 500_000))

    rarest = F.row_number().over(Window.partitionBy("id").orderBy("n", "hash", "offset"))
    prefix = tokens.join(counts, "hash").withColumn("rank", rarest).filter("rank = 1")  # a shingle that never occurs can't match
    whole = F.size("window")
    prefix = scratch.save(prefix.select("id", "hash", "length", "offset").join(windows.select("id", "window"), "id"), "prefix", per(n_windows, 100_000))

    # a place and the words around it, as far as a window over it can reach
    start = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    keys = prefix.select("hash", "length").distinct()
    near = places(rows, keys, lengths, per(keys.count(), BLOCK_HASHES))
    near = near.select("key", "digest", "at", "hash", start.alias("start"), F.size("w").alias("size"), F.slice("w", start + 1, F.col("at") - start + WINDOW).alias("around"))
    near = near.join(F.broadcast(prefix) if n_windows <= BROADCAST_WINDOWS else prefix, "hash").withColumn("begin", F.col("at") - F.col("offset"))
    fits = (F.col("begin") >= 0) & (F.col("begin") + whole <= F.col("size"))
    near = near.filter(fits).filter(F.slice("around", F.greatest(F.col("begin") - F.col("start") + 1, F.lit(1)), whole) == F.col("window"))
    hits = scratch.save(near.select("key", "digest", "begin", (F.col("begin") + whole).alias("end"), "id").distinct(), "hits")

    before = Window.partitionBy("key", "digest").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "digest", "begin", "end").distinct()
    fresh = F.greatest(F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.col("begin"))), F.lit(0))
    n_hit = spans.withColumn("fresh", fresh).groupBy("key", "digest").agg(F.sum("fresh").cast("long").alias("n_hit"))
    of_doc = hits.select("key", "digest", "id").distinct().join(pairs.select("id", "item"), "id").groupBy("key", "digest")
    named_items = of_doc.agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # documents with an occurrence, each with its items
    hit = n_hit.alias("a").join(named_items.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.digest") == F.col("b.digest"))).select("a.key", "a.digest", "n_hit", "items")
    hit = scratch.save(hit, "hit-documents")
    few = hit.count() <= BROADCAST_ROWS
    scratch.leave(hit)
    out = sizes.alias("d").join((F.broadcast(hit) if few else hit).alias("h"), F.col("d.key").eqNullSafe(F.col("h.key")) & (F.col("d.digest") == F.col("h.digest")), "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("d.key").alias(key),
        "n_words",
        n.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"),
        F.col("d.digest").alias("digest"),
    )
