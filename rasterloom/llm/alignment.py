"""Alignment of two tokenizers' tokens by external spill counting.

Texts are cut at single blanks between other characters; neither tokenizer has a token across such a place, so a worker encodes
each different unit once, both ways, and keeps its groups and linked ids in a bounded cache. What documents link is a record
(pair of ids, document, times). A task radix-partitions its records by the second tokenizer's id, sorts each part by pair and
document and compresses it with zstd: a run. Runs go to the shared folder.

A k-way heap merge over the runs of a radix counts each pair. The records of one pair or id may be a large part of all, so runs
are merged in lots of a bounded number, and the lots' counts, a row for each pair, are summed up. Side-major order (by the second
tokenizer's id, then the first's) gives each id's highest count as its pairs pass by. Then the runs stream past the counts of
their radix again and hand on what each adds to its documents, and a document's run collects that of all radices.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.bpe import byte_alphabet
from rasterloom.llm.common import Scratch, per, small_batches, tidy

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Parts of a run, its records about, runs that are merged or streamed in one task, and pairs of a table's chunk.
RADICES, RUN_RECORDS, LOT_RUNS, CHUNK_PAIRS = 32, 1_000_000, 64, 500_000
#: Units that a worker's cache holds and their characters, characters that are encoded at a time, and of a unit encoded with others.
CACHE_UNITS, CACHE_CHARS, BATCH_CHARS, JOINED_CHARS, UNIT_CHARS = 300_000, 8 << 20, 1 << 20, 1 << 15, 256
#: White space other than blanks and line feeds.
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters on which all versions of Unicode agree whether they are letters, digits, white space or others.
SETTLED = re.compile(r"[\x00-\x1b\x20-ɏ̀-ͯΑ-ΡΣ-ωЀ-ҁҊ-ԯ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*")
#: Fixed value: the pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cut(text: str) -> list[str]:
    """The units of blank + text, each without the blank before it."""
    plain = text[0] != " " and text[-1] != " " and "  " not in text and "\n " not in text and " \n" not in text
    return text.split(" ") if plain and not OTHER_SPACE.search(text) else CUT.split(text)


class First:
    """A byte-level BPE vocabulary; texts are encoded with a blank before them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_truncation(), self.library.no_padding()
        spec = json.loads(spec)
        model, number = spec["model"], {c: i for i, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        size = max(model["vocab"].values()) + 1
        self.bytes = [b""] * max(size, self.library.get_vocab_size())
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        before, cutter = spec["normalizer"], spec["pre_tokenizer"] or {}
        usual = before is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
        self.quick = None
        if usual and not model.get("ignore_merges") and merged == sorted(merged) and len(set(merged)) == len(merged):
            import tiktoken  # merges by rank as well, and its ranks are these ids

            ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
            self.quick = tiktoken.Encoding(uuid.uuid4().hex, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def joined(self, text: str) -> list[int]:
        if self.quick and SETTLED.fullmatch(text):
            return self.quick(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Second:
    """A piece vocabulary, which puts the blank before a text by itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes beyond a blank

    def joined(self, text: str) -> list[int]:
        return self.library.encode(text[1:], num_threads=1)

    def alone(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


class Units:
    """The units that a worker has met: numbers of tokens and groups, the groups as text, and the linked ids."""

    def __init__(self, a: First, b: Second):
        self.a, self.b = a, b
        self.length = [np.array([len(x) for x in v.bytes], np.int64) for v in (a, b)]
        self.name = [[str(i) for i in range(len(v.bytes))] for v in (a, b)]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((4, 1 << 12), np.int64)  # tokens of either side, groups, and where their links begin
        self.fine = np.zeros(1 << 12, bool)
        self.links = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def keep(self, units: list[str], fine: bool, a: np.ndarray, b: np.ndarray, groups: np.ndarray, texts: list[str], links: np.ndarray) -> None:
        at, n = len(self.text), len(units)
        while at + n > len(self.fine):
            self.counts, self.fine = np.pad(self.counts, ((0, 0), (0, len(self.fine)))), np.pad(self.fine, (0, len(self.fine)))
        while self.used + len(links) > len(self.links):
            self.links = np.pad(self.links, (0, len(self.links)))
        self.slot.update(zip(units, range(at, at + n), strict=True))
        self.text += texts
        self.counts[:, at : at + n] = a, b, groups, self.used + np.cumsum(groups) - groups
        self.fine[at : at + n] = fine
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)
        self.held += sum(map(len, units))

    def align(self, units: list[str], whole: bytes, a: list[int], b: list[int]) -> bool:
        """Keep units whose tokens follow each other; False if their bytes aren't those of the text or don't part at the units' ends."""
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return False
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        a_, b_ = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.length[0][a_]), np.cumsum(self.length[1][b_])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last = np.searchsorted(both, ends)
        if not (both[np.minimum(last, len(both) - 1)] == ends).all():
            return False
        to_a, to_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        name_a, name_b = [self.name[0][i] for i in a], [self.name[1][i] for i in b]
        parts, i, j = [], 0, 0
        for p, q in zip((to_a + 1).tolist(), (to_b + 1).tolist(), strict=True):
            parts.append(f"{name_a[i]}|{name_b[j]}" if p - i == q - j == 1 else f"{','.join(name_a[i:p])}|{','.join(name_b[j:q])}")
            i, j = p, q
        stops = (last + 1).tolist()
        texts = [";".join(parts[i:j]) for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        tokens = [np.diff(to[last] + 1, prepend=0) for to in (to_a, to_b)]
        self.keep(units, True, *tokens, np.diff(last + 1, prepend=0), texts, b_[to_b] << 32 | a_[to_a])
        return True

    def learn(self, units: list[str]) -> None:
        """Encode units that aren't known yet: many together where they part by themselves, others alone."""
        batch, size, apart = [], 0, []
        for u in units:
            if not self.b.splits or not u or len(u) > UNIT_CHARS or u[0].isspace() or u[-1].isspace():
                apart.append(u)
                continue
            batch.append(u)
            size += len(u) + 1
            if size >= JOINED_CHARS:
                apart += self.together(batch)
                batch, size = [], 0
        apart += self.together(batch)
        for i in range(0, len(apart), 1000):
            some = apart[i : i + 1000]
            texts = [" " + u for u in some]
            for u, t, a, b in zip(some, texts, self.a.alone(texts), self.b.alone(texts), strict=True):
                if not self.align([u], t.encode(), a, b):
                    none = np.zeros(1, np.int64)
                    self.keep([u], False, none, none, none, [""], np.zeros(0, np.int64))

    def together(self, units: list[str]) -> list[str]:
        if not units:
            return []
        text = " " + " ".join(units)
        return [] if self.align(units, text.encode(), self.a.joined(text), self.b.joined(text)) else units

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text its counts (tokens of either side, groups), its groups, and the linked pairs with their text's place."""
        if len(self.slot) > CACHE_UNITS or self.held > CACHE_CHARS:
            self.clear()
        cuts = [cut(t) if t else [] for t in texts]
        known = self.slot
        if fresh := list(dict.fromkeys(u for units in cuts for u in units if u not in known)):
            self.learn(fresh)
        counts, groups, own, place = np.zeros((3, len(texts)), np.int64), [], [], []
        for k, units in enumerate(cuts):
            slots = list(map(known.__getitem__, units))
            at = np.array(slots, np.int64)
            if not units or not self.fine[at].all():
                groups.append("")
                continue
            counts[:, k] = self.counts[:3, at].sum(axis=1)
            groups.append(";".join(map(self.text.__getitem__, slots)))
            own.append(at)
            place.append(np.full(len(at), k))
        if not own:
            return counts, groups, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, place = np.concatenate(own), np.concatenate(place)
        n, begin = self.counts[2, at], self.counts[3, at]
        flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return counts, groups, self.links[flat], np.repeat(place, n)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each by planes of their bytes, compressed by zstd."""
    planes = [np.frombuffer(np.ascontiguousarray(x, np.int64).tobytes(), np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.array([len(x)], np.int64).tobytes() + p for x, p in zip(arrays, planes, strict=True)))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.frombuffer(planes.T.tobytes(), np.int64))
        at += 8 + 8 * n
    return out


class Run:
    """Records of some documents, gathered until there are enough for a run."""

    def __init__(self, number: int):
        self.number, self.documents, self.size = number, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, pairs: np.ndarray, places: np.ndarray, documents: int) -> None:
        """Links of further documents: equal ones of one document become one record."""
        if len(pairs):
            kinds, kind = np.unique(pairs, return_inverse=True)
            keys, times = np.unique(kind * documents + places, return_counts=True)
            self.parts.append((kinds[keys // documents], self.documents + keys % documents, times))
            self.size += len(keys)
        self.documents += documents

    def spilt(self, part: int) -> Iterator[dict]:
        """The run as rows, one for each radix."""
        if not self.parts:
            return
        pairs, places, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        radix = (pairs >> 32) % RADICES
        order = np.lexsort((places, pairs, radix))
        pairs, places, times, radix = (x[order] for x in (pairs, places, times, radix))
        ends = np.searchsorted(radix, np.arange(RADICES + 1))
        for r, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if i < j:
                own, first, n = np.unique(pairs[i:j], return_index=True, return_counts=True)
                total = np.add.reduceat(times[i:j], first)
                pairs_, records = pack(np.diff(own, prepend=0), total), pack(n, places[i:j], times[i:j])
                yield {"part": part, "run": self.number, "documents": self.documents, "radix": r, "pairs": pairs_, "records": records}


_UNITS: dict[str, Units] = {}
COUNTS = ("n_a", "n_b", "n_groups")


def encoded(docs: DataFrame, key: str, text: str, first: str, second: str, groups: str) -> DataFrame:
    """Rows of documents (radix is null) and rows of runs."""
    context = docs.sparkSession.sparkContext
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        specs = context.broadcast((f.read(), g.read()))  # vocabulary files, a few MB
    small_batches(docs.sparkSession)
    number = uuid.uuid4().hex
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    schema = f"part int, run int, place int, key {kind}, n_a long, n_b long, n_groups long, groups string, documents int, radix int, pairs binary, records binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if number not in _UNITS:
            _UNITS.clear()
            _UNITS[number] = Units(First(specs.value[0]), Second(specs.value[1]))
        units, part, gathered = _UNITS[number], TaskContext.get().partitionId(), Run(0)
        fields = None
        for batch in batches:
            fields = fields or output_fields(batch.schema.field("key").type)
            texts = batch.column("text")
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < BATCH_CHARS:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                counts, joined, pairs, places = units.documents(some)
                if groups == "digest":
                    joined = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in joined]
                rows = {"part": np.full(len(some), part), "run": np.full(len(some), gathered.number), "place": gathered.documents + np.arange(len(some))}
                rows |= dict(zip(COUNTS, counts, strict=True)) | {"groups": joined if groups else [None] * len(some)}
                yield row_batch(fields, len(some), rows, batch.column("key").slice(at, len(some)))
                gathered.add(pairs, places, len(some))
                at += len(some)
                if gathered.size >= RUN_RECORDS:
                    for spilt in gathered.spilt(part):
                        yield row_batch(fields, 1, {c: [v] for c, v in spilt.items()})
                    gathered = Run(gathered.number + 1)
        if fields:
            for spilt in gathered.spilt(part):
                yield row_batch(fields, 1, {c: [v] for c, v in spilt.items()})

    return slim.mapInArrow(tidy(run), schema)


def output_fields(key: pa.DataType) -> pa.Schema:
    small, wide = pa.int32(), pa.int64()
    kinds = {"part": small, "run": small, "place": small, "key": key, "n_a": wide, "n_b": wide, "n_groups": wide, "groups": pa.string(), "documents": small, "radix": small, "pairs": pa.binary(), "records": pa.binary()}
    return pa.schema(list(kinds.items()))


def row_batch(fields: pa.Schema, n: int, values: dict, key: pa.Array | None = None) -> pa.RecordBatch:
    columns = [key if f.name == "key" and key is not None else pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in fields]
    return pa.RecordBatch.from_arrays(columns, schema=fields)


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Each pair in ascending order with its count, by a heap merge of the runs."""

    def stream(data: bytes) -> Iterator[tuple[int, int]]:
        steps, totals = unpack(data)
        return zip(np.cumsum(steps).tolist(), totals.tolist(), strict=True)

    at, sum_ = None, 0
    for pair, n in heapq.merge(*map(stream, runs)):
        if pair != at:
            if at is not None:
                yield at, sum_
            at, sum_ = pair, 0
        sum_ += n
    if at is not None:
        yield at, sum_


def lots(rows: DataFrame, number: int):
    return F.pmod(F.xxhash64("part", "run"), F.lit(number)).cast("int")


def counted(runs: DataFrame, number: int) -> DataFrame:
    """(b, a, n, best) of each linked pair of ids: how many links, and whether no pair of the same b has more."""
    dealt = runs.select("radix", lots(runs, number).alias("lot"), "pairs").repartition("radix", "lot").sortWithinPartitions("radix", "lot")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            pairs, counts = [], []
            for pair, n in merged(held):
                pairs.append(pair), counts.append(n)
                if len(pairs) == CHUNK_PAIRS:
                    yield pair_batch(pairs, counts)
                    pairs, counts = [], []
            if pairs:
                yield pair_batch(pairs, counts)

        at, held = None, []
        for batch in batches:
            for radix, lot, data in zip(*(batch.column(c).to_pylist() for c in ("radix", "lot", "pairs")), strict=True):
                if (radix, lot) != at:
                    yield from out(held)
                    at, held = (radix, lot), []
                held.append(data)
        yield from out(held)

    parts = dealt.mapInArrow(tidy(merge), "b int, a int, n long")
    summed = parts.groupBy("b", "a").agg(F.sum("n").alias("n"))
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def pair_batch(pairs: list[int], counts: list[int]) -> pa.RecordBatch:
    codes = np.array(pairs, np.int64)
    return pa.RecordBatch.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(counts, pa.int64())], ["b", "a", "n"])


def chunks(pairs: DataFrame) -> DataFrame:
    """(radix, data): the counts of a radix's pairs in side-major order, compressed."""
    dealt = pairs.withColumn("radix", F.col("b") % RADICES).repartition(RADICES, "radix").sortWithinPartitions("radix", "b", "a")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radix, b, a, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("radix", "b", "a", "n", "best"))
            codes = b.astype(np.int64) << 32 | a
            cuts = [0, *(np.flatnonzero(radix[1:] != radix[:-1]) + 1).tolist(), len(radix)]
            some = [(int(radix[i]), pack(np.diff(codes[i:j], prepend=0), n[i:j], best[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j]
            yield pa.RecordBatch.from_pydict({"radix": pa.array([r for r, _ in some], pa.int32()), "data": pa.array([d for _, d in some], pa.binary())})

    return dealt.mapInArrow(tidy(packed), "radix int, data binary")


def contributions(runs: DataFrame, tables: DataFrame, number: int) -> DataFrame:
    """(part, run, sums): what one radix's records of a run add to its documents' count_sum and n_best."""
    none = F.lit(None)
    streamed = runs.select("radix", lots(runs, number).alias("lot"), F.lit(True).alias("is_run"), "part", "run", "documents", "pairs", "records")
    copied = tables.select("radix", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("lot"), F.lit(False).alias("is_run"), none.cast("int").alias("part"), none.cast("int").alias("run"), none.cast("int").alias("documents"), F.col("data").alias("pairs"), none.cast("binary").alias("records"))
    dealt = copied.unionByName(streamed).repartition("radix", "lot").sortWithinPartitions("radix", "lot", "is_run")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, table = None, [], None
        for batch in batches:
            for radix, lot, is_run, part, run, documents, pairs, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (radix, lot) != at:
                    at, parts, table = (radix, lot), [], None
                if not is_run:
                    steps, n, best = unpack(pairs)
                    parts.append((np.cumsum(steps), n, best))
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    order = np.argsort(table[0], kind="stable")
                    table, parts = [x[order] for x in table], []
                steps, _ = unpack(pairs)
                each, places, times = unpack(records)
                found = np.repeat(np.searchsorted(table[0], np.cumsum(steps)), each)
                sums = [np.zeros(documents, np.int64) for _ in range(2)]
                np.add.at(sums[0], places, times * table[1][found])
                np.add.at(sums[1], places, times * table[2][found])
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": pa.array([run], pa.int32()), "sums": pa.array([pack(*sums)], pa.binary())})

    return dealt.mapInArrow(tidy(stream), "part int, run int, sums binary")


def collected(documents: DataFrame, added: DataFrame) -> DataFrame:
    """Documents with count_sum and n_best: a run's documents follow what all radices add to them."""
    kind = documents.schema["key"].dataType.simpleString()
    own = documents.withColumns({"is_document": F.lit(True), "sums": F.lit(None).cast("binary")})
    more = added.select("part", "run", F.lit(False).alias("is_document"), "sums")
    dealt = more.unionByName(own, allowMissingColumns=True).repartition("part", "run").sortWithinPartitions("part", "run", "is_document", "place")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            part, run, is_document = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "run", "is_document"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (run[1:] != run[:-1]) | (is_document[1:] != is_document[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if i == j:
                    continue
                if (part[i], run[i]) != at:
                    at, sums = (part[i], run[i]), None
                some = batch.slice(i, j - i)
                if not is_document[i]:
                    for data in some.column("sums").to_pylist():
                        new = unpack(data)
                        sums = new if sums is None else [x + y for x, y in zip(sums, new, strict=True)]
                    continue
                place = some.column("place").to_numpy()
                total, best = ([np.zeros(len(place), np.int64)] * 2) if sums is None else (x[place] for x in sums)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("key", *COUNTS, "groups")), pa.array(best), pa.array(total)], ["key", *COUNTS, "groups", "n_best", "count_sum"])

    return dealt.mapInArrow(tidy(gather), f"key {kind}, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = BYTE_BPE, second: str = PIECE_BPE, groups: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) and linked pairs of ids (a, b, n, best).

    Texts are encoded with a blank before them, special strings as plain text. The byte offsets where tokens of both sides end
    cut them into groups; the last tokens of a group are linked. n counts a pair's links in all documents; count_sum sums that up
    over a document's links, and n_best counts those whose pair is the most frequent of its b (ties count). groups: "text" gives
    `a1,a2|b1;a3|b2` of ids, "digest" the lowercase SHA-256 of that (empty without tokens), "" a null.

    Texts that are null, empty, or not given back by either side's tokens byte by byte have no tokens: zeros and an empty text.
    Null keys and repeated rows are documents like others, each by itself; ties are all best; very long texts are encoded whole.
    An empty table gives empty ones. Other columns, whatever their names, aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    both = scratch.save(encoded(docs, key, text, first, second, groups), "encoded")
    runs = both.filter(F.col("radix").isNotNull()).select("part", "run", "documents", "radix", "pairs", "records")
    number = per(runs.select("part", "run").distinct().count(), LOT_RUNS)
    pairs = scratch.save(counted(runs, number), "pairs")
    tables = scratch.save(chunks(pairs), "chunks")
    documents = both.filter(F.col("radix").isNull()).select("part", "run", "place", "key", *COUNTS, "groups")
    found = collected(documents, contributions(runs, tables, number))
    out = found.select(F.col("key").alias(key), *COUNTS, F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
    return out, pairs.select("a", "b", "n", "best")


@cache
def vocabularies(first: str = BYTE_BPE, second: str = PIECE_BPE) -> tuple[First, Second]:
    """Both vocabularies in this process."""
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        return First(f.read()), Second(g.read())
