"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(docs: DataFrame, text: str, *made: str) -> tuple[DataFrame, str, list[Column]]:
    """docs with its columns named c0, c1, ..., so that no name of theirs meets one of an operator; which of these is the text;
    and the columns that give them their names back. Columns named like what the operator makes, in any case, are left out:
    it replaces them."""
    names = [c for c in docs.columns if c.lower() not in made]
    own = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(names)))
    at = names.index(text) if text in names else [c.lower() for c in names].index(text.lower())
    return own, f"c{at}", [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local master that has none gets a temporary folder;
    on a cluster that would be another one on each machine, so there it must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


class Scratch:
    """Tables written into the shared folder to cut lineage; drop() and leave() remove those no longer read, and what a result
    still reads goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/rasterloom-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder), files.deleteOnExit(folder)
        self.count = 0
        self.saved: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """df written and to be read again; dealt evenly over so many files where its size is known to be small for its tasks."""
        self.count += 1
        df = df if files is None else df.repartition(files)
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved[path] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
            self.saved.pop(df._scratch_path, None)

    def leave(self, *frames: DataFrame) -> None:
        """Drop all tables but these, which the result still reads."""
        kept = {df._scratch_path for df in frames}
        self.drop(*(df for path, df in list(self.saved.items()) if path not in kept))


#: Rows of an Arrow batch; ten times as many hold some 100 MB of text in each worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session hand at most BATCH_ROWS rows at once to Python workers: their memory follows the batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory of this worker to the system: it waits beside the JVM for its next task, maybe for long."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run):
    """run, a function over an iterator of Arrow batches, with the worker's memory given back at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def per(rows: int, most: int) -> int:
    """The number of files for rows, `most` in each."""
    return max(1, -(-rows // most))


def fold(column, modulus: int):
    """crc32 of the id as text, modulo: the split of labelled rows into learnt and held out."""
    return F.crc32(column.cast("string")) % modulus
