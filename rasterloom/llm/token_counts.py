"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Texts are cut into pre-tokens as the vocabulary's own normaliser and pattern do. Tier one is a compact hash table of the
frequent ones' lengths in tokens: sorted 128-bit hashes beside small numbers, broadcast to all workers. Every task counts its own
pre-tokens in a bounded summary and hands on hashes, lengths and counts of the most frequent, numbers all; those with the
largest sums over the whole corpus make up the table. Tier two encodes what the table lacks with the library, through a cache in
each worker that is bounded in bytes.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.bpe import pieces
from rasterloom.llm.common import small_batches, tidy

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Pre-tokens that a task hands on, and those in the table.
TASK_WORDS, TABLE_WORDS = 8192, 65_536
#: Bytes that the younger half of a worker's cache may hold, and the longest pre-token that it keeps.
CACHE_BYTES, CACHED_LENGTH = 12 << 20, 128
#: What a normaliser and a pattern must be for ASCII texts to be cut by ASCII classes; white space is dropped either way.
USUAL = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Texts with other characters are cut by the library: Unicode's versions may differ on them, and \x1c-\x1f are no white space to it.
UNSETTLED = re.compile("[^\x00-\x1b\x20-ɏ̀-ͯΑ-ΡΣ-ωЀ-ҁҊ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
ENTRY = [("low", "<u8"), ("high", "<u8")]


class Cutter:
    """A vocabulary's pre-tokens, and their lengths in tokens by the library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        spec = json.loads(spec)
        given = spec["pre_tokenizer"] or {"type": "Sequence", "pretokenizers": []}
        steps = given["pretokenizers"] if given["type"] == "Sequence" else [given]
        to_bytes = [s for s in steps[-1:] if s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"]]
        steps = steps[: len(steps) - len(to_bytes)]
        none = {"type": "BPE", "vocab": {}, "merges": []}
        small = spec | {"model": none, "added_tokens": [], "post_processor": None, "decoder": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
        cut = Tokenizer.from_str(json.dumps(small))
        self.normal = cut.normalizer.normalize_str if cut.normalizer else str
        self.split = cut.pre_tokenizer.pre_tokenize_str
        whole = spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": to_bytes[0] if to_bytes else None}
        self.encode = Tokenizer.from_str(json.dumps(whole)).encode_batch_fast
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        pattern = steps[0]["pattern"].get("Regex") if len(steps) == 1 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] else None
        self.settled = regex.compile(pattern).findall if pattern == USUAL[1] else None
        self.ascii = spec["normalizer"] == USUAL[0] and pattern == USUAL[1]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.ascii and text.isascii():
            return ASCII_WORDS.findall(text.lower())
        plain = self.normal(text)
        if self.settled and not UNSETTLED.search(plain):
            return self.settled(plain)
        return [w for w, _ in self.split(plain)]

    def cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings, of one token each, stand between them."""
        if self.special is None or not self.special.search(text):
            return self.words(text), 0
        parts = self.special.split(text)
        return [w for p in parts[::2] for w in self.words(p)], len(parts) // 2

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.encode(words, add_special_tokens=False)]


def hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), ENTRY)


def trim(counts: Counter, most: int = TASK_WORDS) -> Counter:
    """The Misra-Gries step: take the count of the first word that doesn't fit from all, and keep what is left."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


_CUTTERS: dict[int, Cutter] = {}


def cutter(spec: str) -> Cutter:
    """The cutter of this worker process, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(spec)
    if key not in _CUTTERS:
        _CUTTERS.clear()
        _CUTTERS[key] = Cutter(spec)
    return _CUTTERS[key]


def frequent(docs: DataFrame, spec, text: str = "text") -> np.ndarray:
    """The table: hashes (ENTRY) and n, sorted by hash; TABLE_WORDS entries at most. spec: the vocabulary, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = cutter(spec.value), Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in pieces(texts):
                for t in texts[part]:
                    total.update(own.cut(t or "")[0])
                if len(total) > 8 * TASK_WORDS:
                    total = trim(total)
        words, counts = list(total := trim(total)), list(total.values())
        h = hashes(words)
        yield pa.RecordBatch.from_pydict({"low": pa.array(h["low"].view("<i8")), "high": pa.array(h["high"].view("<i8")), "n": pa.array(own.lengths(words), pa.int32()), "seen": pa.array(counts, pa.int64())})

    found = docs.select(F.col(text)).mapInArrow(tidy(run), "low long, high long, n int, seen long")
    summed = found.groupBy("low", "high").agg(F.max("n").alias("n"), F.sum("seen").alias("seen"))
    rows = summed.orderBy(F.col("seen").desc(), "low", "high").limit(TABLE_WORDS).select("low", "high", "n").toPandas()
    table = np.empty(len(rows), [*ENTRY, ("n", "<i4")])
    for name in ("low", "high"):
        table[name] = rows[name].to_numpy(np.int64).view("<u8")
    table["n"] = rows["n"]
    return np.sort(table, order=["low", "high"])


class Counts:
    """Token counts of texts in one worker."""

    def __init__(self, cut: Cutter, table: np.ndarray):
        self.cutter, self.table = cut, table
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0

    def look_up(self, words: list[str]) -> dict[str, int]:
        """The lengths of different pre-tokens: by the table, else by the cache, else by the library."""
        known: dict[str, int] = {}
        if len(self.table) and words:
            h = hashes(words)
            at = np.minimum(np.searchsorted(self.table["low"], h["low"]), len(self.table) - 1)
            hit = (self.table["low"][at] == h["low"]) & (self.table["high"][at] == h["high"])
            known = dict(zip([words[i] for i in np.flatnonzero(hit)], self.table["n"][at[hit]].tolist(), strict=True))
        fresh: list[str] = []
        for w in words:
            if w not in known:
                n = self.young.get(w)
                if n is None:
                    n = self.old.get(w)
                    if n is None:
                        fresh.append(w)
                        continue
                    self.keep(w, n)
                known[w] = n
        for part in pieces(fresh):
            for w, n in zip(fresh[part], self.cutter.lengths(fresh[part]), strict=True):
                known[w] = n
                self.keep(w, n)
        return known

    def keep(self, word: str, n: int) -> None:
        if len(word) <= CACHED_LENGTH:
            self.held += 4 * len(word) + 120
            self.young[word] = n
            if self.held > CACHE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cutter.cut(t) for t in texts]
        length = self.look_up(list(dict.fromkeys(chain.from_iterable(w for w, _ in cut)))).__getitem__
        return [sum(map(length, words)) + special for words, special in cut]


_COUNTS: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for each row.

    A null text counts as empty: 0 bytes, 0 tokens. Null keys, ties and repeated rows pass through; long texts are
    counted whole; other columns aren't read. An empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, spec, text))  # 20 bytes for each of TABLE_WORDS
    number = uuid.uuid4().hex
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[number] = Counts(cutter(spec.value), table.value)
        counts = _COUNTS[number]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [x for part in pieces(texts) for x in counts.count([t or "" for t in texts[part]])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    out = slim.mapInArrow(tidy(run), f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
