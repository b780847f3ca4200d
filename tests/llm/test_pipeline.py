from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bpe, decontam, near_dup, secret_scan
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_near_dup import brute as components

HEX = "f4d46ac9a61fbb0cd8a4c9e67a05cf5b1d1f2a33"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, prose):
    """A small corpus with toxic documents, copies, benchmark passages and secrets."""
    draw, root = random.Random(3), tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    items = [(i, prose(1000 + i, 20)) for i in range(5)]
    for i in range(150):
        w = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[draw.randrange(60)] = draw.choice(["idiot", "moron", "scum"])
        text = " ".join(w)
        if i % 10 == 1:
            text += " " + items[i % 5][1]
        if i % 10 == 2:
            text += f' token = "{HEX}" end'
        docs.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(200 + i, docs[i][1] + " more", "en", "src1", len(docs[i][1]) + 5) for i in range(1, 20, 3)]
    docs += [(300, None, None, None, None), (301, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def stage(name):
    return dict(cp.STAGES)[name]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "BPE"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in cp.STAGES[:-1]:
        assert f(spark, docs, sf_dir).columns == docs.columns, name


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {i for i, _ in pairs(stage("toxicity")(spark, docs, sf_dir))}
    toxic = {i for i, t in pairs(docs) if t and any(x in t.split() for x in ("idiot", "moron", "scum"))}
    everyone = {i for i, _ in pairs(docs)}
    assert not kept & toxic and kept == everyone - toxic


def test_one_of_each_group_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {i for i, _ in pairs(stage("near duplicates")(spark, docs, sf_dir))}
    assert kept == {i for i, _, _, own in components(pairs(docs)) if own}


def test_contaminated_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i for i, _ in pairs(stage("decontamination")(spark, docs, sf_dir))}
    assert kept == {i for i, _, _, _, bad in contaminated(pairs(docs), items) if not bad}


def test_secrets_are_masked(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in stage("secrets")(spark, docs, sf_dir).collect()}
    for r in docs.collect():
        want = r.text and r.text.replace(HEX, secret_scan.MASK)
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (r.n_chars if want == r.text else len(want))


def test_run_applies_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in cp.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf_dir).collect(), docs.schema)
    tok = Tokenizer.from_file(bpe.BYTE_BPE)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in pairs(docs)}
    got = {r.doc_id: r for r in cp.run(spark, sf_dir).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want and all(r.n_tokens == len(r.ids) for r in got.values())
    assert 0 < len(got) < 150


def test_native_operators_have_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert near_dup.near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_near_duplicates_by_id_and_text(spark, docs, prose):
    a, b, c, d, e = (prose(9000 + i, 40) for i in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, d + " more"), (4, e), (4, e + " more"), (5, ""), (5, "")]
    got = sorted(pairs(stage("near duplicates")(spark, docs(rows), "")), key=repr)
    assert [x for x in got if x[0] not in (None, 4)] == [(1, a), (2, b), (3, c), (5, ""), (5, "")]
    assert [x[0] for x in got if x[0] in (None, 4)] == [4, None]


ODD = ["doc_id", "text", "lang", "source", "n_chars", "toxicity", "Secrets", "key", "digest", "component", "a.b"]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows_and_clashing_columns(spark, sf_dir, docs, prose, name):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like those that operators make."""
    long = prose(9, 30_000)
    rows = [(None, None), (1001, None), (1002, ""), (1002, ""), (1003, "   "), (None, prose(6, 30)), (1004, long), (1005, prose(7, 30)), (1006, prose(8, 3))]
    df = docs(rows)
    for c in ODD[5:]:
        df = df.withColumn(c, F.coalesce(F.col("doc_id"), F.lit(-1)) * 10)
    out = stage(name)(spark, df, sf_dir)
    if name == "BPE":
        tok = Tokenizer.from_file(bpe.BYTE_BPE)
        got = sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=repr)
        assert got == sorted(((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    else:
        assert out.columns == ODD
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)  # nothing to reject or to mask


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table(spark, sf_dir, docs, name):
    assert stage(name)(spark, docs([]), sf_dir).count() == 0


def test_repeated_rows_are_judged_together(spark, sf_dir, docs, prose):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean, secret = prose(6000, 30), f'token = "{HEX}" {prose(6001, 20)}'
    rows = [(1, items[0]), (1, items[0]), (None, items[1]), (1, clean), (2, clean), (2, clean), (None, secret), (7, secret), (7, secret)]
    kept = sorted(pairs(stage("decontamination")(spark, docs(rows), sf_dir)), key=repr)
    assert kept == sorted(rows[3:], key=repr)
    masked = sorted(pairs(stage("secrets")(spark, docs(rows), sf_dir)), key=repr)
    assert masked == sorted([(i, t.replace(HEX, secret_scan.MASK)) for i, t in rows], key=repr)
