"""Operator 1: benchmark decontamination by winnowing. DataFrame functions only.

Windows are so many consecutive words of an item; a shorter item is one window. Of a window's k-gram
hashes the smallest are its fingerprints, and as a document keeps every k-gram that is smallest in
some window of its own, a window shared by both has a fingerprint in common. Fingerprints are joined,
hits extend to the words around them, and what surrounds a hit is compared word by word.

Defined cases: a null text has no words and an item without words no windows; texts are read whole;
rows that repeat an id and text are returned each; items that repeat an id count as one; a null
item_id names no item but its windows count as hits; a null doc_id is an id like another; empty
tables give documents without hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, table

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Broadcast up to so many fingerprints or windows of the benchmark.
SMALL_BENCHMARK = 500_000


def words(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits and whatever isn't ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def grams(ws: Column, k: int) -> Column:
    """Hashes of k consecutive words, by start."""
    n = F.size(ws) - (k - 1)
    return F.when(n > 0, F.transform(F.slice(ws, 1, F.greatest(n, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def reach(length: int) -> tuple[int, int]:
    """(k, w): fingerprints of k words, smallest of w in a window of `length` words."""
    k = max(1, (length + 1) // 2)
    return k, length - k + 1


def window_minima(hashes: Column, w: int) -> Column:
    """Smallest of w hashes, by start."""
    n = F.size(hashes) - (w - 1)
    return F.when(n > 0, F.transform(F.slice(hashes, 1, F.greatest(n, F.lit(0))), lambda _, i: least([F.get(hashes, i + j) for j in range(w)]))).otherwise(F.array().cast("array<bigint>"))


def least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def benchmark_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """Distinct (item_id, length, window): a window is its words joined by a space."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(length))
    cut = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))
    return items.select("item_id", n.alias("length"), F.explode(cut).alias("window")).distinct()


def hits(docs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """docs(doc, ws) -> (doc, start, window) of the occurrences of windows of this length."""
    k, w = reach(length)
    wanted = windows.filter(F.col("length") == length).select("window").distinct()
    prints = wanted.select(F.array_min(grams(F.split("window", " "), k)).alias("print")).distinct()
    hashed = docs.select("doc", "ws", grams(F.col("ws"), k).alias("h"))
    hashed = hashed.select("doc", "ws", "h", window_minima(F.col("h"), w).alias("low"))
    # A hash is kept if it is the smallest of a window that it is in: the largest of their minima.
    kept = F.transform("h", lambda x, i: F.when(greatest([F.get("low", F.when(i >= j, i - j)) for j in range(w)]) == x, F.struct(
        x.alias("print"), F.greatest(i - (w - 1), F.lit(0)).alias("at"), i.alias("i"))))
    near = F.transform(F.filter(kept, lambda x: x.isNotNull()), lambda x: F.struct(
        x["print"].alias("print"), x["at"].alias("at"), F.array_join(F.slice("ws", x["at"] + 1, x["i"] + length - x["at"]), " ").alias("near")))
    # The outer kinds of explode keep the optimizer from filtering by arrays that it would make anew for each word.
    found = hashed.select("doc", F.explode_outer(near).alias("x")).select("doc", "x.print", "x.at", "x.near").join(small(prints, SMALL_BENCHMARK), "print")
    around = F.split("near", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size("around") - (length - 1)), lambda i: F.struct(
        (F.col("at") + i - 1).cast("long").alias("start"), F.array_join(F.slice("around", i, length), " ").alias("window")))
    extended = found.withColumn("around", around).select("doc", F.explode_outer(cut).alias("x")).select("doc", "x.start", "x.window")
    return extended.join(small(wanted, SMALL_BENCHMARK), "window").select("doc", "start", F.lit(length).alias("length"), "window")


def covered(spans: Column) -> Column:
    """Number of words under spans (start, length), each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, hash of the text, n_words, n_hit, items, with a row for each document."""
    windows = benchmark_windows(benchmark, length)
    spec = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).alias("doc")
    split = docs.select(spec, words(F.col("text")).alias("ws"))
    # Shorter windows, if there are any, are searched on their own: a handful of lengths at most.
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    n_words = F.size(F.col("ws")).cast("long").alias("n_words")
    none = docs.sparkSession.createDataFrame([], "start bigint, length int, window string")
    rows = split.select("doc", n_words, *[F.lit(None).cast(t).alias(c) for c, t in none.dtypes])
    for n in lengths:
        rows = rows.unionByName(hits(split, windows, n).withColumn("n_words", F.lit(None).cast("long")))
    by_doc = rows.groupBy("doc").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("spans"), F.collect_set("window").alias("found"))
    by_doc = by_doc.select("doc", "n_words", "copies", covered(F.col("spans")).alias("n_hit"), F.explode_outer("found").alias("window"))
    named = small(windows.select("window", F.col("item_id").cast("string").alias("item")).distinct(), SMALL_BENCHMARK)
    out = by_doc.join(named, "window", "left").groupBy("doc", "n_words", "copies", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.select("doc", "n_words", "n_hit", "items", every.alias("copy")).select("doc.doc_id", "doc.hash", "n_words", "n_hit", "items")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """How many words of every document stand in windows of the benchmark; a null text has no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, l WHERE len(ws) >= n)),
h AS (SELECT DISTINCT doc_id, i, g.n, item_id FROM g JOIN w ON g.win = w.win AND g.n = w.n),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
