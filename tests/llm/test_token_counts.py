from __future__ import annotations

import random
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from rasterloom.llm import token_counts as tc
from rasterloom.llm.bpe import BYTE_BPE

SPEC = open(tc.WORD_BPE, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)


EMPTY = np.empty(0, [*tc.ENTRY, ("n", "<i4")])


def some_texts(n):
    draw = random.Random(3)
    pieces = [*"abAB ét\n\t ,.'sdl1290ß漢 \x1c\x85Σσİ\x00\x7f\u3000’“—½²٣Ⅷ", "'ll", "'S", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "  ", "é", "😀", "\u0301", "ﬁ", "K", "Å"]
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(3000)] + ["a" * 4000, ""]


def test_any_text():
    texts = some_texts(3000)
    assert tc.Counts(tc.Cutter(SPEC), EMPTY).count(texts) == [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabulary():
    spec = open(BYTE_BPE, encoding="utf-8").read()
    texts = some_texts(3000)
    assert tc.Counts(tc.Cutter(spec), EMPTY).count(texts) == [len(e) for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]


def test_cache_is_bounded_in_bytes():
    counts = tc.Counts(tc.Cutter(SPEC), EMPTY)
    draw = random.Random(8)
    long = ["".join(draw.choice("abcdefgh") for _ in range(20_000)) for _ in range(30)]
    many = [" ".join("".join(draw.choice("abcdefgh") for _ in range(20)) for _ in range(5000)) for _ in range(60)]
    assert counts.count(long) == [len(e) for e in LIBRARY.encode_batch(long, add_special_tokens=False)]
    assert not counts.young and not counts.old
    for t in many:
        counts.count([t])
        assert sum(4 * len(w) + 120 for half in (counts.young, counts.old) for w in half) <= 2 * tc.CACHE_BYTES + 300
    assert counts.old


def test_summary_keeps_heavy_hitters():
    draw = random.Random(1)
    total, true = Counter(), Counter()
    for _ in range(200):
        part = [draw.choice("ab") if draw.random() < 0.4 else str(draw.randrange(5000)) for _ in range(100)]
        true.update(part)
        total = tc.trim(total + Counter(part), 20)
    assert len(total) <= 20 and {"a", "b"} <= set(total) and all(total[w] <= true[w] for w in total)


def test_table(docs, spark):
    rows = [(1, "Hello world, it's 42"), (2, None), (3, ""), (4, "é" * 3000), (4, "é" * 3000), (None, "x y")]
    table = docs(rows).toDF("doc_id", "text", "n_tokens", "n_bytes", "key")
    got = sorted(map(tuple, tc.count_tokens(table, limit=5).collect()), key=repr)
    n = [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((i, len((t or "").encode()), k, k > 5) for (i, t), k in zip(rows, n, strict=True)), key=repr)
    assert tc.count_tokens(docs([])).count() == 0


def test_table_covers_all_documents_and_only_numbers_are_shuffled(docs, spark, monkeypatch):
    texts = [f"the word{i} the" for i in range(50)]
    plans = []
    monkeypatch.setattr(type(docs([])), "toPandas", lambda df, f=type(docs([])).toPandas: (plans.append(df.schema), f(df))[1])
    table = tc.frequent(docs(list(enumerate(texts))), spark.sparkContext.broadcast(SPEC))
    assert all(f.dataType.simpleString() in ("bigint", "int") for f in plans[0])
    cut = tc.Cutter(SPEC)
    words = sorted({w for t in texts for w in cut.cut(t)[0]})
    want = sorted(zip(*(tc.hashes(words)[c].tolist() for c in ("low", "high")), cut.lengths(words), strict=True))
    assert list(map(tuple, table.tolist())) == want
    counts = tc.Counts(cut, table)
    assert counts.count(texts) == [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)] and not counts.young
