"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case of the letters that "lower-cases A-Z" means.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words that are split at ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Partitions of a bounded sample of labelled rows.
TRAINING_PARTS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where it is unset, as in tests on one machine, a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not current.isDefined() and (not master.startswith("local") or "cluster" in master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="callweave-")
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder; what made them is not run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts that are all ASCII take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int, size: int = 1 << 25) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows and bytes (as JSON); beyond that Spark shuffles both sides."""
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("n"))
    n, total = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


class Scratch:
    """Tables that a job writes to the shared folder on its way; those that nothing reads any more are dropped."""

    #: Bytes of an Arrow batch that a Python worker gets while a table is written.
    BATCH, SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written and read again; a table of that name is forgotten, not overwritten."""
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(self.SETTING, None)
        self.spark.conf.set(self.SETTING, self.BATCH)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.SETTING, before) if before else self.spark.conf.unset(self.SETTING)
        self.spark.sparkContext._jvm.System.gc()  # lets Spark drop shuffle files that nothing needs any more
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def any(self, df: DataFrame) -> bool:
        return not df.isEmpty()

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names; what was made of them has to be written by now."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            for path in self.paths.pop(name, []):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: compressed, and free of what made them."""
    return Scratch(df.sparkSession).keep(df, name)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents, those with the smallest hashed ids; held-out ids are never among them."""
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(TRAINING_PARTS)


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fifth that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
