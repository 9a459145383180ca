"""Tables that driver and executors share: what cuts the lineage of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset, as in tests on one machine, a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="callweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Into how many parts the session shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Hashes by which values are counted before any is counted by itself.
HASHES = 1 << 16


def frequent(df: DataFrame, name: str, most: int) -> list:
    """Values of a column that more than `most` rows have; null is none of them. Counts by hash move next to nothing, and only rows whose hash has so many are counted by value."""
    bin_ = F.pmod(F.hash(name), F.lit(HASHES))
    full = [r.bin for r in df.groupBy(bin_.alias("bin")).agg(F.count(name).alias("n")).filter(F.col("n") > most).collect()]
    counted = df.filter(bin_.isin(full)).groupBy(name).agg(F.count(name).alias("n")).filter(F.col("n") > most) if full else None
    return [r[name] for r in counted.select(name).collect()] if full else []


def bucketed(df: DataFrame, by: list[str], once: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder in buckets, one file each, and read again; joins by these columns don't move them. once: repeats are left out, which moves nothing more, and rows sorted, so that what they become is packed well."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = partitions(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    placed = df.repartition(n, *by)
    to = (placed.distinct() if once else placed).write.format("parquet").bucketBy(n, *by).option("path", path)
    (to.sortBy(*by) if once else to).saveAsTable(name)
    return spark.table(name)


def numbered(df: DataFrame, order: list[str | Column], name: str = "idx", part: str | None = None) -> DataFrame:
    """The rows with their number in an order, from 0: ranges are sorted side by side, and each begins after those before it. `part` names a column for the number of the range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # One row for each partition, so that the running sum over all of them is small.
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_base"))
    return rows.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_base") + F.col("_at")).cast("long").alias(name), *([F.col("_part").alias(part)] if part else []))
