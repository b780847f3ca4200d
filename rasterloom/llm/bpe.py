"""BPE encoding and decoding: batched numpy merge rounds.

Texts are cut into words by classes of characters, in numpy; what class a character has is asked of the library once. Arrow numbers
the different words of some megabytes of text, and those that the worker's bounded cache doesn't hold go through the rounds.

The symbols of many words lie in one flat array. Each round finds the lowest rank of every word and merges all its occurrences at
once; pairs that this makes are looked up by binary search over the sorted pair keys. Words with no pair left drop out.

Words beyond LONG_WORD bytes leave the rounds for a heap of their pairs, with the same result and lookups in the same keys.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import small_batches, tidy

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
NO_RANK = np.iinfo(np.int32).max
#: Longer words are merged one by one with a heap: rounds over them would cost the square of their length.
LONG_WORD = 1024
#: Bytes that the younger half of a worker's cache may hold, a word counted with WORD_COST, and the longest word that it keeps.
CACHE_BYTES, WORD_COST, CACHED_LENGTH = 48 << 20, 300, 256
#: Characters that are taken at a time where lists of words are made of them (they take some twenty times as much).
BATCH_BYTES = 1 << 20
#: Characters that are encoded at a time (arrays over them take some ten times as much), and bytes of words that are merged at a time.
PIECE_BYTES, MERGE_BYTES = 4 << 20, 1 << 18
#: The pre-tokenizer whose words are cut by classes of characters, and these classes; any other cuts by itself.
USUAL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
LETTER, NUMBER, MARK, SPACE, UNKNOWN = range(5)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of some stretches of these lengths begins, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def binary(data, bounds: np.ndarray) -> pa.Array:
    """The stretches of data between bounds as an Arrow column, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64, copy=False)), pa.py_buffer(data)])


def bounds_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1] or bytes(8), np.int64)[column.offset : column.offset + len(column) + 1]


def data_of(column: pa.Array) -> np.ndarray:
    """The bytes that the bounds of a column point into."""
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[: bounds_of(column)[-1]]


def spread(data, bounds: np.ndarray, chosen: np.ndarray) -> pa.Array:
    """The chosen stretches of data, one after another."""
    return binary(data, bounds).take(pa.array(chosen))


class MergeTable:
    """A byte-level BPE vocabulary as sorted pair keys, their ranks and results."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        letters = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.byte_ranks = self.lookup(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).astype(np.int32).reshape(256, 256)
        byte_of = {c: b for b, c in enumerate(letters)}
        token_bytes = [b""] * self.base
        for token, i in vocab.items():
            token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.token_bytes = pa.array(token_bytes, pa.large_binary())

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, NO_RANK where they have none."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, which lie in data between bounds, and the offsets of each (one more than words)."""
        lengths = np.diff(bounds)
        if lengths.max(initial=0) <= LONG_WORD:
            done = self.rounds(data, lengths)
        else:
            short = lengths <= LONG_WORD
            numbers, ids = self.rounds(data[np.repeat(short, lengths)], lengths[short])
            done = [np.flatnonzero(short).astype(np.int32)[numbers]], [ids]
            for i in np.flatnonzero(~short):
                done[1].append(self.merge_long(data[bounds[i] : bounds[i + 1]]))
                done[0].append(np.full(len(done[1][-1]), i, np.int32))
            done = tuple(map(np.concatenate, done))
        order = np.argsort(done[0], kind="stable")
        return done[1][order], offsets_of(np.bincount(done[0], minlength=len(lengths)))

    def rounds(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id its word's number, and the ids; those of a word stand in order. Only pairs that a merge made are looked up again."""
        sym = self.byte_ids[data]
        own = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        rank = np.full(len(sym), NO_RANK, np.int32)  # of a symbol and its right neighbour
        rank[:-1] = self.byte_ranks[data[:-1], data[1:]]
        rank[:-1][own[1:] != own[:-1]] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym)))
            over = best == NO_RANK
            chosen = np.flatnonzero((rank == best) & ~over)
            # in a run of overlapping pairs (a a a) every second one is merged, from the left
            first = np.diff(chosen, prepend=-2) != 1
            if not first.all():
                run_start = np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run_start) % 2 == 0]
            sym[chosen] = self.merged[rank[chosen]]
            keep = ~over
            if not keep.all():
                done.append((own[over], sym[over]))
            keep[chosen + 1] = False
            made = (np.cumsum(keep, dtype=np.int32) - 1)[chosen]  # where the merged symbols will stand
            sym, own, rank = sym[keep], own[keep], rank[keep]
            if not len(sym):
                break
            changed = np.zeros(len(sym), bool)
            changed[made] = changed[made[made > 0] - 1] = True
            changed[-1], rank[-1] = False, NO_RANK
            left = np.flatnonzero(changed)
            found = self.lookup(sym[left], sym[left + 1])
            rank[left] = np.where(own[left] == own[left + 1], found, NO_RANK)
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """One word with a heap of its pairs: the same result in n log n steps."""
        ranks = self.byte_ranks[word[:-1], word[1:]]
        found = ranks != NO_RANK
        sym = self.byte_ids[word].tolist()
        before, after, live = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1)), [True] * len(sym)
        heap = [(r, i, sym[i], sym[i + 1], m) for i, r, m in zip(np.flatnonzero(found).tolist(), ranks[found].tolist(), self.merged[ranks[found]].tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= len(sym) or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j] = merged, False
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(sym):
                    key = sym[p] * self.base + sym[q]
                    k = bisect_left(self.keys, key)
                    if k < len(self.keys) and self.keys[k] == key:
                        heapq.heappush(heap, (rank := int(self.ranks[k]), p, sym[p], sym[q], int(self.merged[rank])))
        return np.array([s for s, ok in zip(sym, live, strict=True) if ok], np.int32)


class Known:
    """Different words and the ids of each, flat, between bounds."""

    def __init__(self, words: pa.Array, ids: np.ndarray, bounds: np.ndarray):
        self.words, self.ids, self.bounds = words, ids, bounds

    def __len__(self) -> int:
        return len(self.words)

    @classmethod
    def none(cls) -> Known:
        return cls(pa.array([], pa.large_binary()), np.empty(0, np.int32), np.zeros(1, np.int64))

    def __add__(self, other: Known) -> Known:
        return Known(pa.concat_arrays([self.words, other.words]), np.concatenate([self.ids, other.ids]), np.concatenate([self.bounds, self.bounds[-1] + other.bounds[1:]]))

    def take(self, chosen: np.ndarray) -> Known:
        taken = spread(self.ids, 4 * self.bounds, chosen)
        return Known(self.words.take(pa.array(chosen)), data_of(taken).view(np.int32), bounds_of(taken) // 4)


class Encoder:
    """Encodes texts in one worker; the cache is bounded and only saves work."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(spec)
        spec = json.loads(spec)
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        self.split = Tokenizer.from_str(json.dumps(bare)).pre_tokenizer.pre_tokenize_str
        self.usual = USUAL.items() <= spec["pre_tokenizer"].items()
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        special = self.table.special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.fixed = Known(pa.array([s.encode() for s in special], pa.large_binary()), np.array([*special.values()], np.int32), np.arange(len(special) + 1))
        self.ids = self.old_ids = Known.none()
        self.held = 0

    def kind(self, code: int) -> int:
        """A character's class, as the library has it: whether it makes one word with a letter, a digit or a mark before it."""
        return next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (MARK, "!")) if len(self.split(before + chr(code))) == 1), SPACE)

    def kinds_of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if (unknown := kinds == UNKNOWN).any():
            for c in np.unique(codes[unknown]).tolist():
                self.kinds[c] = self.kind(c)
            kinds = self.kinds[codes]
        return kinds

    def begins(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which characters begin a word of the usual pattern; first: which begin a part, and the end."""
        kinds = self.kinds_of(codes)
        begin = first[:-1].copy()
        begin[1:] |= kinds[1:] != kinds[:-1]
        # before a word the last white space stands alone, a blank goes with the word
        at = np.flatnonzero(begin & ~first[:-1] & (kinds != SPACE))
        at = at[kinds[at - 1] == SPACE]
        begin[at - 1] = True
        begin[at[codes[at - 1] == ord(" ")]] = False
        # 's 't 'm 'd 're 've 'll, where the pattern is tried at the apostrophe
        at = np.flatnonzero(begin & (codes == ord("'")))
        at = at[~first[at + 1]]
        one = at[np.isin(codes[at + 1], [*b"stmd"])]
        at = at[~first[at + 2]]
        two = at[np.isin(codes[at + 1].astype(np.int64) << 32 | codes[at + 2], [a << 32 | b for a, b in (b"re", b"ve", b"ll")])]
        for found, size in ((one, 2), (two, 3)):
            begin[found + 1] = False
            begin[(after := found + size)[after < len(codes)]] = True
        return begin

    def words(self, parts: list[str], special: list[bool]) -> tuple[pa.Array, np.ndarray]:
        """The words of all parts, and the number of each part's first one (and of all). A special string is one word."""
        text = "".join(parts)
        data = text.encode()
        ends = offsets_of(np.fromiter(map(len, parts), np.int64, len(parts)))
        first = np.zeros(len(text) + 1, bool)
        first[ends] = True
        plain = len(data) == len(text)
        codes = np.frombuffer(data, np.uint8) if plain else np.frombuffer(text.encode("utf-32-le"), "<u4")
        if self.usual:
            begin = self.begins(codes, first)
        else:
            begin = first[:-1].copy()
            for part, at in zip(parts, ends.tolist(), strict=False):
                begin[[at + a for _, (a, _) in self.split(part)]] = True
        for i in np.flatnonzero(special):
            begin[ends[i] + 1 : ends[i + 1]] = False
        at = np.flatnonzero(begin)
        if plain:
            bounds = np.append(at, len(data))
        else:
            bounds = offsets_of(np.add.reduceat(np.uint8(1) + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), at, dtype=np.int64))
        return binary(data, bounds), np.searchsorted(at, ends)

    def keep(self, more: Known) -> None:
        """Put words into the younger half of the cache; where they don't fit, it becomes the older one and takes those that do."""
        sizes = np.cumsum(4 * np.diff(more.bounds) + 5 * np.diff(bounds_of(more.words)) + WORD_COST)
        if len(more) and self.held + sizes[-1] > CACHE_BYTES:
            self.old_ids, self.ids, self.held = self.ids, Known.none(), 0
            fits = int(np.searchsorted(sizes, CACHE_BYTES, "right"))
            more, sizes = more.take(np.arange(fits)), sizes[:fits]
        if len(more):
            self.ids += more
            self.held += int(sizes[-1])

    def learn(self, words: pa.Array) -> Known:
        """Different words with their ids by merge rounds, MERGE_BYTES at a time."""
        data, bounds = data_of(words), bounds_of(words)
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        begin = 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + MERGE_BYTES, "right")) - 1)
            own, offsets = self.table.merge_words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin])
            ids.append(own)
            counts.append(np.diff(offsets))
            begin = end
        return Known(words, np.concatenate(ids), offsets_of(np.concatenate(counts)))

    def known(self, words: pa.Array) -> Known:
        """Different words with their ids: special strings, words of the younger half of the cache, else of the older, else learnt."""
        pool = self.fixed + self.ids + self.old_ids
        at = pc.index_in(words, value_set=pool.words).fill_null(-1).to_numpy()
        fresh = at < 0
        pool += self.learn(words.filter(pa.array(fresh)))
        chosen = np.where(fresh, len(pool) - fresh.sum() + np.cumsum(fresh) - 1, at)
        found = pool.take(chosen)
        newly = fresh | (at >= len(self.fixed) + len(self.ids))
        self.keep(found.take(np.flatnonzero(newly & (np.diff(bounds_of(words)) <= CACHED_LENGTH))))
        return found

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, where those of each begin (and end), the bytes that they decode to, and where those begin."""
        parts, special, begins = [], [], [0]
        for t in texts:
            own = self.special.split(t) if self.special and any(s in t for s in self.table.special) else [t]
            parts += own
            special += [i % 2 == 1 for i in range(len(own))]
            begins.append(len(parts))
        words, numbers = self.words(parts, special)
        numbers = numbers[begins]
        coded = words.dictionary_encode()
        found, order = self.known(coded.dictionary), coded.indices.to_numpy()
        tokens = self.table.token_bytes.take(pa.array(found.ids))
        ids = spread(found.ids, 4 * found.bounds, order)
        shown = spread(data_of(tokens), bounds_of(tokens)[found.bounds], order)
        return data_of(ids).view(np.int32), bounds_of(ids)[numbers] // 4, data_of(shown), bounds_of(shown)[numbers]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as int32 bytes, and the bytes that they decode to."""
        ids, of_ids, shown, of_shown = self.flat(texts)
        return [(ids[a:b].tobytes(), shown[c:d].tobytes()) for a, b, c, d in zip(of_ids, of_ids[1:], of_shown, of_shown[1:], strict=False)]

    def arrays(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The same as columns: lists of ids, and decoded texts."""
        ids, of_ids, shown, of_shown = self.flat(texts)
        decoded = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(of_shown.astype(np.int32)), pa.py_buffer(shown)])
        try:
            decoded.validate(full=True)
        except pa.ArrowInvalid:  # ids whose bytes are no UTF-8
            decoded = pa.array([shown[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(of_shown, of_shown[1:], strict=False)], pa.string())
        return pa.ListArray.from_arrays(pa.array(of_ids.astype(np.int32)), pa.array(ids)), decoded


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def pieces(texts: list, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of at most `most` characters, or one text."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += len(t or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """key, ids (array of int, as the tokenizers library gives them without added special tokens) and decoded (text).

    One row for each input row; other columns aren't read, so their names can't clash. A null text counts as empty;
    an empty text gives no ids and an empty decoded text. Null keys, ties and repeated rows pass through; very long
    texts are encoded whole. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB, the size of the vocabulary file
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in pieces(texts, PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("key")[part.start : part.stop], *enc.arrays(texts[part])], ["key", "ids", "decoded"])

    return slim.mapInArrow(tidy(run), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_columns() -> list[Column]:
    """n_tokens, and SHA-256 of ids (decimal, joined by commas) and of decoded."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and the digests of an encoded table."""
    return encoded.select(key, *digest_columns())
