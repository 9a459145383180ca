"""Operator 13: shards by vector bin packing.

Documents with the same text are a group, and a group is a vector: its bytes, words and rows. Each group
goes to the shard where the dot product of its vector with what the shard has left is highest, groups
with the largest part of any of the three first. What a shard has is an equal part of everything, in each
of the three.

Groups that hold more than 1/BIG of all bytes, words or rows are placed first. There are 3 * BIG of them
at most, whatever the input, and they are the only ones that the driver sees. Of these, a group above
1/PIECES of a shard is split by hashed ids, into parts of 1/FINE of a shard, as no shard could hold it and
be even.

All other groups are dealt to lanes by their hash, some LANE groups each. What the shards have left is
dealt to the lanes by what the lanes hold, and each lane is packed on its own: as lanes end with their
smallest groups, a lane's error is that of a few small texts.

Places in a shard follow the ids: ranges are sorted side by side, and begin after those before them.

Defined cases: a null text is an empty one, of one byte and no words; null ids come first in a shard;
rows that repeat id and text share a shard, and rows of one id follow each other by the checksum of
their text; columns other than doc_id and text are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir, table, word_count

SHARDS = 16
#: Groups above this part of everything are placed first; those above this part of a shard are split, into such parts of a shard.
BIG, PIECES, FINE = 4096, 2, 16
#: Small groups of a lane.
LANE = 20_000
#: What is balanced.
SUMS = ["bytes", "words", "rows"]
#: What tells texts apart.
KEY = ["hash", "text_crc32", "size"]


def with_key(text: Column) -> list[Column]:
    """Two hashes and the size of a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("hash"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size")]


def highest(left: np.ndarray, items: np.ndarray, after: float = 0.0) -> np.ndarray:
    """The shard of each item, in turn: where the dot product with what is left is highest. left: by shard, is used up.

    Both vectors are measured by what is still to be placed of each sum, `after` these items too, so that
    a sum that is nearly used up, as bytes are before rows, is evened out while there is something to do it with.
    """
    out = np.empty(len(items), dtype=np.int32)
    to_come = np.maximum(np.cumsum(items[::-1], axis=0)[::-1] + after, 1e-12) ** -2
    for k, weighed in enumerate(items * to_come):
        out[k] = s = int((left @ weighed).argmax())
        left[s] -= items[k]
    return out


def piece(n: Column) -> Column:
    """Which of n pieces of its group a document belongs to."""
    return F.pmod(F.xxhash64(F.lit("piece"), F.col("doc_id")), n).cast("int")


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows(doc_id, KEY, words, ...), kept -> with shard: where the group of each row goes."""
    spark = rows.sparkSession
    groups = keep(rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.sum("words").alias("words")).withColumn("bytes", F.col("rows") * F.col("size")), "groups")
    total = groups.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first()
    whole = np.array([max(1, total[c]) for c in SUMS], dtype=np.float64)
    part = F.greatest(*[F.col(c) / F.lit(float(w)) for c, w in zip(SUMS, whole)])
    cuts = F.when(part * F.lit(shards * PIECES) > 1, F.ceil(part * F.lit(shards * FINE))).otherwise(1).cast("int")
    # A part above 1 / BIG: 3 * BIG groups at most, as BIG of them for each sum.
    big = F.broadcast(keep(groups.filter(part * F.lit(BIG) > 1).select(*KEY, cuts.alias("cuts")), "big-groups"))
    of_big = rows.join(big, KEY).withColumn("piece", piece(F.col("cuts")))
    pieces = of_big.groupBy(*KEY, "piece").agg(F.count("*").alias("rows"), F.sum("words").alias("words")).withColumn("bytes", F.col("rows") * F.col("size")).toPandas()
    pieces["most"] = -(pieces[SUMS] / whole).max(axis=1)
    pieces = pieces.sort_values(["most", *KEY, "piece"], ignore_index=True)
    left = np.full((shards, len(SUMS)), 1.0 / shards)
    items = pieces[SUMS].to_numpy(dtype=np.float64) / whole
    rest = np.maximum(1.0 - items.sum(axis=0), 1e-300)  # what all small groups hold
    at = highest(left, items, rest)
    known = [(int(r.hash), int(r.text_crc32), int(r.size_), int(r.piece), int(s)) for r, s in zip(pieces.rename(columns={"size": "size_"}).itertuples(), at)]
    placed_big = of_big.join(F.broadcast(spark.createDataFrame(known, "hash long, text_crc32 long, size long, piece int, shard int")), [*KEY, "piece"]).select(*rows.columns, "shard")

    def pack(lane: pd.DataFrame) -> pd.DataFrame:
        own = np.maximum(lane[SUMS].to_numpy(dtype=np.float64).sum(axis=0), 1.0)
        lane["most"] = -(lane[SUMS] / own).max(axis=1)
        lane = lane.sort_values(["most", *KEY], ignore_index=True)
        sums = lane[SUMS].to_numpy(dtype=np.float64)
        return lane[KEY].assign(shard=highest(left / rest, sums / own))

    lanes = max(1, -(-total["groups"] // LANE))
    small = groups.join(big, KEY, "left_anti").withColumn("lane", F.pmod(F.xxhash64(F.lit("lane"), *KEY), F.lit(lanes)))
    packed = small.groupBy("lane").applyInPandas(pack, "hash long, text_crc32 long, size long, shard int")
    placed_small = rows.join(big, KEY, "left_anti").join(packed, KEY).select(*rows.columns, "shard")
    return placed_big.unionByName(placed_small)


def slots(placed: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows with slot: their number in their shard, from 0, by the order."""
    by = ["shard", *order]
    ranged = keep(placed, "placed").repartitionByRange(*by).sortWithinPartitions(*by)
    rows = keep(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranged")
    # A row for each partition and shard in it: a range of shards has few of both, so that the sums are small.
    sizes = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("shard", "_part", (before - F.col("_first")).alias("_base"))
    return rows.join(F.broadcast(bases), ["shard", "_part"]).select(*placed.columns, (F.col("_base") + F.col("_at")).cast("long").alias("slot"))


def pack(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, hash, text_crc32, size (bytes and one), words, shard, slot."""
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *with_key(F.col("text")), word_count(F.col("text")).alias("words")), "measured")
    return slots(place(rows, shards), [F.col("doc_id").asc_nulls_first(), "text_crc32", "hash", "size"])


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, files: int = 1) -> str:
    """Writes docs(doc_id, text, ...) as Parquet, a folder for each shard, in so many files each; returns the path."""
    path = path or f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    keys = ["_id", *(f"_{c}" for c in KEY)]
    found = pack(docs.select("doc_id", "text"), shards).select("shard", F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), *[c.alias(f"_{k}") for k, c in zip(KEY, with_key(F.col("text")))])
    same = F.lit(True)
    for c in keys:
        same = same & keyed[c].eqNullSafe(found[c])
    rows = keyed.join(found, same).select("row", "shard", keyed["_id"].alias("_by"))
    dealt = rows.repartition(shards * files, "shard", F.pmod(F.xxhash64("_by"), F.lit(files))).sortWithinPartitions("shard", "_by")
    dealt.select(F.col("shard").alias("_shard"), "row.*").write.partitionBy("_shard").parquet(path)
    return path


def op13_shards(spark, sf_dir: str) -> DataFrame:
    """The shard and place of every document by law `bytes`: sizes are near equal, and so are words and rows."""
    found = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "words")
