"""A training corpus from documents: toxic documents go, of near duplicates one stays, contaminated ones go, secrets are masked,
and what is left is encoded. Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontam, near_dup, secret_scan, toxicity
from rasterloom.llm.common import Scratch, table

#: Rows of ids that may be broadcast (some 30 bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def bounded(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def set_aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns renamed that bear the name of one that an operator makes, and the columns that restore docs."""
    names = {c: f"rasterloom_aside_{i}" if c.lower() in made else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(f"`{now}`").alias(c) for c, now in names.items()]


#: Names of a row's id and the digest of its text, beside the columns of documents.
KEY, DIGEST = "rasterloom_key", "rasterloom_digest"


def without(docs: DataFrame, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose id (a null is an id) and text aren't among rows (KEY, DIGEST)."""
    same = F.col("doc_id").eqNullSafe(F.col(KEY)) & (F.xxhash64("text") == F.col(DIGEST))
    return docs.join(bounded(rows.select(KEY, DIGEST)), same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learnt from the labels, doesn't reject.

    Null and empty texts stay, as they have no toxic passage; long texts are scanned whole. Repeated rows and null ids are judged
    by their texts like others. Without labels of both kinds all rows get one score, the share of toxic labels. An empty
    table stays empty. Other columns, whatever their names, pass through.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnt())
    own, back = set_aside(docs, "toxicity", "passages")
    return toxicity.score(own, model).filter("toxicity < 0.5").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, then the smallest digest of its text.

    Rows are told apart by id and text: a text without another copy stays whatever becomes of other texts under its id. Of
    repeated rows one stays. A null id comes after all others. Null texts and such without words have no duplicates, all of
    them stay; long texts are compared whole. An empty table stays empty. Other columns, whatever their names, pass through.
    """
    found = near_dup.near_duplicates(docs, carry=True).filter(F.col("component").isNotNull())
    counted = Scratch(spark).save(found.groupBy("component", "component_id", F.col("doc_id").alias(KEY), F.col("digest").alias(DIGEST)).agg(F.count("*").alias("n")), "rows")
    first = F.col(KEY).eqNullSafe(F.col("component_id"))  # only such a row can stay; of each group there is one, if ids don't repeat
    best = counted.filter(first).groupBy("component").agg(F.min(DIGEST).alias("best"))
    firsts = counted.filter(first).join(best, "component").select(KEY, DIGEST, (F.col(DIGEST) == F.col("best")).alias("kept"), "n")
    judged = firsts.unionByName(counted.filter(~first).select(KEY, DIGEST, F.lit(False).alias("kept"), "n"))
    judged = Scratch(spark).save(judged.filter("not kept or n > 1"), "duplicates")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = without(docs, judged).select(*columns)
    repeated = without(docs, judged.filter("kept and n > 1"), "inner").dropDuplicates([KEY, DIGEST]).select(*columns)
    return once.unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated with benchmark items.

    Null and empty texts stay, and all texts if the benchmark is empty; long texts are searched whole. Rows are told apart by id
    and text, so repeated rows go or stay together, with a null id too. An empty table stays empty. Other columns, whatever
    their names, pass through.
    """
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias(KEY), F.col("digest").alias(DIGEST)).distinct()
    found = Scratch(spark).save(found, "contaminated")
    return without(docs, found).select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked, and n_chars follows the text.

    Null and empty texts stay as they are; long texts are searched whole. Repeated rows and null ids are masked like others. An
    empty table stays empty. Other columns, whatever their names, pass through.
    """
    own, back = set_aside(docs, "n_candidates", "secrets")
    found = secret_scan.scan(own, secret_scan.train(secret_scan.labelled_findings(spark)))
    changed = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and digest, and the digest of the text that they decode to.

    One row for each row, repeated ones and those with a null id too. A null text counts as empty: no ids. Long texts are
    encoded whole. An empty table gives an empty one. Other columns aren't read.
    """
    encoded = bpe.encode_decode(docs)
    return encoded.select("doc_id", "ids", *bpe.digest_columns())


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("BPE", encode),
]

#: Learnt models and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again, then that before it removed."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.leave(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
