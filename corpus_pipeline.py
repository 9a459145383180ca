"""A corpus pipeline of five training-data operators; each stage is written as Parquet and read as the next one's documents.

Each function takes (spark, docs, sf_dir). Toxicity drops documents that are scored toxic, the n-gram
Jaccard join leaves the smallest id of each group, decontamination drops documents with words of
benchmark windows, mixing repeats or leaves out documents by the targets of their sources, and the
last stage writes token files and returns what they hold.

Repeated documents keep their ids, so that the last stage has a row for each copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import decontaminate, jaccard, mixing, token_binary, toxicity
from callweave.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from labelled rows of these documents. Null and empty texts score as texts without n-grams; rows that repeat are judged each; of an empty table nothing is left."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")), model)
    return scored.filter("score < 0.5").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest id of their component, or have no id; of rows that repeat id and text, one."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    kept = found.filter("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = rows.join(kept.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    return left.dropDuplicates(["doc_id", "hash"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word that stands in a window of the benchmark. Null and empty texts have none and stay, as do all of their rows; rows that repeat id and text go together."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = found.filter("n_hit > 0").select(F.struct("doc_id", "hash").alias("of")).distinct()
    rows = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(bad, F.col("key").eqNullSafe(F.col("of")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words, null ones too, take no share of a target; rows of one id are drawn alike; a null source is one of its own."""
    return mixing.emit(mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; returns doc_id, start, n_tokens, ids_crc32, read back from them. Null and empty texts are an end id, null ids come first, rows that repeat are written each, and an empty table gives no rows."""
    return token_binary.read_tokens(token_binary.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_binary", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a tokenizer are part of it.
ORACLE_SQL = None
