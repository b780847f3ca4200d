from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from rasterloom.llm import alignment as al
from tokenizers import Tokenizer


LIBRARY = Tokenizer.from_file(al.BYTE_BPE)
LIBRARY.encode_special_tokens = True


def whole(text):
    """Tokens of one text by the libraries, over the whole of it, as (id, bytes); None where the bytes aren't its own."""
    first, second = al.vocabularies()
    ids = LIBRARY.encode(" " + text, add_special_tokens=False).ids, second.library.encode(text)
    tokens = [[(i, v.bytes[i]) for i in x] for v, x in zip((first, second), ids, strict=True)]
    return tokens if all(b"".join(t for _, t in x) == (" " + text).encode() for x in tokens) else None


def brute(rows):
    groups, links, seen = [], [], Counter()
    for _, text in rows:
        own, linked = [], []
        if text and (tokens := whole(text)):
            ends = []
            for side in tokens:
                at, e = 0, []
                for _, t in side:
                    at += len(t)
                    e.append(at)
                ends.append(e)
            both = sorted(set(ends[0]) & set(ends[1]))
            before = 0
            for e in both:
                a, b = ([i for (i, _), x in zip(side, s, strict=True) if before < x <= e] for side, s in zip(tokens, ends, strict=True))
                own.append((a, b))
                linked.append((a[-1], b[-1]))
                before = e
        groups.append(own), links.append(linked), seen.update(linked)
    most = Counter()
    for (_, b), n in seen.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), own, linked in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        out.append((key, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(linked), sum(seen[x] == most[x[1]] for x in linked), sum(seen[x] for x in linked), text))
    return sorted(out, key=repr), {(a, b, n, n == most[b]) for (a, b), n in seen.items()}


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "x\ty z", "a  b", "a  b", "é ß 漢字 かな 한글", "🙂 🙂🙂", "▁ is a mark", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "it's don't we'll I'VE", "0 12 345 6789",
    "é ́x", "\x00 \x1c \x1f y", "  　 z", "ſ İ ͸  \U000e0001", "....... !!! ,;", "a" * 3000, "ab " * 700, "﻿bom", "x‍y ​z", "tab\tend ", "line\r\nline \r\n", " lead", "trail  ", "-- —– “q” ‘q’",
]


def test_units_equal_the_whole_text():
    """Every text's groups, put together from its units, are those of the libraries over the whole of it."""
    draw, units = random.Random(3), al.Units(*al.vocabularies())
    alphabet = ["a", "The", "ing", " ", " ", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "12", ".", "-", " ", "▁", "́", "\x1c", "\x85", "ſ", "͸"]
    texts = ODD + ["".join(draw.choice(alphabet[: draw.choice([6, 8, 15, 23])]) for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    rows = list(enumerate(texts))
    want, _ = brute(rows)
    for size in (1, 60):
        got = {}
        for i in range(0, len(texts), size):
            counts, groups, pairs, places = units.documents(texts[i : i + size])
            for k, text in enumerate(groups):
                got[i + k] = (*counts[:, k].tolist(), int((places == k).sum()), text)
        assert got == {r[0]: (*r[1:5], r[7]) for r in want}


@pytest.fixture
def rows(prose):
    texts = [prose(i % 60, 5 + 7 * (i % 23)) for i in range(300)] + ODD + ["the same " * 40] * 100
    return list(enumerate(texts)) + [(None, "no key here"), (3, "same key"), (3, "same key")]


def test_equals_brute_force(spark, monkeypatch, rows):
    """Small runs, so that many are merged, in several lots."""
    for name, value in (("RUN_RECORDS", 400), ("LOT_RUNS", 3), ("BATCH_CHARS", 3000), ("CACHE_UNITS", 300), ("CHUNK_PAIRS", 50)):
        monkeypatch.setattr(al, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    documents, pairs = al.align(docs)
    want, linked = brute(rows)
    assert sorted(map(tuple, documents.collect()), key=repr) == want
    assert {tuple(r) for r in pairs.collect()} == linked


def test_digest_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string").selectExpr("*", "1 as key", "2 as part", "3 as RUN", "4 as groups", "5 as `a.b`", "6 as radix", "7 as n_a")
    got = {r.doc_id: r.groups for r in al.align(docs, groups="digest")[0].collect()}
    assert got == {r[0]: hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "" for r in brute(rows[:40])[0]}
    assert {r.groups for r in al.align(docs, groups="")[0].collect()} == {None}


def test_keys_of_other_kinds(spark):
    docs = spark.createDataFrame([("k", "some text"), (None, "more"), ("k", None)], "doc_id string, text string")
    assert sorted(map(tuple, al.align(docs)[0].collect()), key=repr) == brute([("k", "some text"), (None, "more"), ("k", None)])[0]


def test_empty(spark):
    for rows in ([], [(1, None), (2, "")]):
        documents, pairs = al.align(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [tuple(r) for r in documents.orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
        assert pairs.count() == 0
