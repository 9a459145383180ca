"""Operator 3: mix sources to target weights.

Tokens are added up by source, targets follow from weights, a budget and a cap on repetition,
and each document is emitted floor(rate) times plus once more if a draw seeded by its id falls
below the fraction of the rate.

Defined cases: a null text has size 0 and is never emitted twice for free (its copies add no
words); null is a source of its own, the last one; rows that repeat an id share its draw; an
empty table gives an empty table; columns of the input that have names of the output are left
out of `mix` and kept as they are by `emit`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table, word_count

#: Sources that are broadcast at most; more are joined by a shuffle.
SMALL_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """(source, source_size) -> with target: shares of budget * all sizes by weight, none above cap * its size.

    Shares that are above their cap stop there and the rest is dealt again by weight. Sources sorted
    by cap / weight reach their caps in this order, so running sums give the same targets at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    k = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (k + 1).cast("int")).cast("double")
    out = sizes.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    out = out.withColumn("room", F.col("most") / F.col("w")).withColumn("total", budget * F.sum("source_size").over(everything))
    out = out.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    out = out.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = out.withColumn("full", F.col("most") * F.col("w_left") <= F.col("w") * F.col("left"))
    # Beyond the full ones all share what is left alike.
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0)),
             F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level[0] / level[1])
    return out.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id and seed only, the same on every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, copies, and the row itself as `row`."""
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = small(source_targets(sizes, weights, budget, cap).withColumnRenamed("source", "of"), SMALL_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("rate")) + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .select("doc_id", "size", "source_size", "target", copies.alias("copies"), "row")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document. As copies are drawn, what a source gives nears its target as the source grows: within some percent for thousands of documents, not for a few."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, most / w AS room, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM w),
b AS (SELECT *, total - coalesce(sum(most) OVER p, 0) AS rest, w_all - coalesce(sum(w) OVER p, 0) AS w_left FROM r
      WINDOW p AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * w_left <= w * rest AS is_full FROM b),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE
        w * (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (floor(rate) + (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
   < rate - floor(rate))::INT))::BIGINT AS taken
FROM x
"""
