"""The registered queries that SQL can't express, over small tables, against brute force."""

from __future__ import annotations

import hashlib

from rasterloom.llm import queries
from tests.llm.test_alignment import ODD, brute
from tests.llm.test_html_text import PARTS, TEXT, article


def test_token_alignment(spark, docs, prose, tmp_path):
    rows = list(enumerate([*ODD, *(prose(i % 7, 20 + i) for i in range(40))]))
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_token_alignment(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows)[0]]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_html_text(spark, tmp_path):
    whole = "\n".join(TEXT)
    rows = [(i, f"https://example.com/{i}", f"<body>{part}{article('<article>', '</article>')}{part}</body>", whole) for i, part in enumerate(PARTS.values())] + [(98, "u", None, ""), (99, None, "", "")]
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op12_html_text(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect())) == sorted((i, url, text, len(text)) for i, url, _, text in rows)


def test_hard_negatives_move_labels(spark, tmp_path):
    """Where the id is divisible by 7 the label is the next one, before anything else."""
    rows = [(0, [1.0, 0.0], 3), (7, [0.9, 0.0], 3), (1, [0.8, 0.0], 4), (14, [0.5, 0.0], 4), (2, [0.6, 0.0], 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2, 204 * 256, 153 * 256), (0, 1, 2, 14, 204 * 256, 128 * 256), (0, 7, 1, 2, 230 * 256, 153 * 256), (0, 7, 2, 14, 230 * 256, 128 * 256)]
