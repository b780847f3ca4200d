from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import bpe

SPEC = open(bpe.BYTE_BPE, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
ENCODER = bpe.Encoder(SPEC)


def same(texts):
    got = ENCODER.encode(texts)
    for text, (ids, shown), e in zip(texts, got, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == e.ids, text
        assert shown.decode("utf-8", "replace") == LIBRARY.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(texts):
    same(texts)


def test_mixed_white_space_and_specials():
    draw = random.Random(3)
    pieces = [*"abAB ét\n\t ,.'sdl1290ß漢 \x1c\x85", "'ll", "<|endoftext|>", "aaaa", "  ", " \n", "é", "😀"]
    same(["".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(3000)])


def test_long_words_take_the_heap():
    draw = random.Random(6)
    mixed = ["".join(draw.choice("abcdefgh0123ABC") for _ in range(n)) for n in (300, 1023, 1024, 1025, 6000)]
    same(["a" * 5000, "ab" * 3000, "x" * 1025, "é" * 1400, "a" * 1024, *mixed])


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    draw = random.Random(5)
    small = bpe.Encoder(SPEC)
    for _ in range(30):
        texts = [" ".join("".join(draw.choice("abcdefg") for _ in range(3)) for _ in range(30)) for _ in range(4)]
        got = small.encode(texts)
        assert [np.frombuffer(x, np.int32).tolist() for x, _ in got] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert small.held <= 20_000 and len(small.old_ids) <= 20_000 / 300 + 1


def test_long_chunks_are_not_kept():
    draw = random.Random(9)
    small = bpe.Encoder(SPEC)
    texts = ["".join(draw.choice("abcdefg") for _ in range(2000)) for _ in range(20)]
    assert [np.frombuffer(x, np.int32).tolist() for x, _ in small.encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert not small.ids and not small.old_ids


def test_table(docs, spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "a b\nc"), (4, "a b\nc"), (None, "x"), (5, "z" * 20_000)]
    table = docs(rows).toDF("doc_id", "text", "ids", "decoded", "key")  # other columns with the operator's own names
    got = bpe.digests(bpe.encode_decode(table)).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *sha))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(docs([])).count() == 0


@pytest.mark.parametrize("texts", [[], [""], ["", "a"]])
def test_pieces(texts):
    assert [t for s in bpe.pieces(texts, 1) for t in texts[s]] == texts


def test_contractions_and_white_space_around_them():
    draw = random.Random(11)
    pieces = ["'", "'", "s", "re", "ve", "ll", "t", "é", " ", "\n", "　", "1", "!", "ť", "<|endoftext|>"]  # ť: U+0165, whose low byte is an e
    same(["".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(5000)])


def test_all_characters():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 61 == 0)]
    draw = random.Random(12)
    same(["".join(x for c in chars[i : i + 50] for x in (c, draw.choice(["", " ", "a", "1", "!", "'"]))) for i in range(0, len(chars), 50)])


def test_work_of_new_words(monkeypatch):
    """The library is asked for characters, not for words, and only pairs that a merge made are looked up."""
    own, calls, looked = bpe.Encoder(SPEC), [], []
    split, lookup = own.split, own.table.lookup
    monkeypatch.setattr(own, "split", lambda text: calls.append(text) or split(text))
    monkeypatch.setattr(own.table, "lookup", lambda a, b: looked.append(len(a)) or lookup(a, b))
    draw = random.Random(13)
    texts = [" ".join("".join(draw.choice("abcdeé") for _ in range(30)) + draw.choice(",.;!") for _ in range(200)) for _ in range(10)]
    n_ids = sum(len(x) // 4 for x, _ in own.encode(texts))
    merges = sum(len(t.encode()) for t in texts) - n_ids
    assert len(calls) <= 4 * len(set("".join(texts))) and sum(looked) <= 2 * merges


def test_another_pre_tokenizer_cuts_by_itself():
    spec = json.loads(SPEC)
    spec["pre_tokenizer"]["use_regex"] = False
    library, own = Tokenizer.from_str(json.dumps(spec)), bpe.Encoder(json.dumps(spec))
    texts = ["it's  two words", "", "x <|endoftext|> y", "é\n\n1"]
    assert [np.frombuffer(x, np.int32).tolist() for x, _ in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_without_utf8_are_shown_as_the_library_does(monkeypatch):
    own = bpe.Encoder(SPEC)
    flat = (np.array([127, 65], np.int32), np.array([0, 1, 2]), np.frombuffer(b"\xffA", np.uint8), np.array([0, 1, 2]))
    monkeypatch.setattr(own, "flat", lambda texts: flat)
    ids, decoded = own.arrays(["a", "b"])
    assert ids.to_pylist() == [[127], [65]] and decoded.to_pylist() == ["�", "A"]
