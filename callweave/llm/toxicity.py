"""Operator 10: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes at most `max_rows` labelled rows, those whose hashed ids are smallest. Counts of
n-grams by label and the logistic regression run as Spark jobs; what comes back is one weight for
each hashed n-gram, a vector of fixed size.

Defined cases: null and empty texts get the score of a text without n-grams; whole texts are read
however long they are; labels that are null or other than 0 and 1 are not learned from; an id with
several labels counts each of them; with no labels, or those of one class only, every score is the
smoothed share of class 1; repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep, table, training_rows

#: Lengths of n-grams, and slots that they are hashed to.
GRAMS, SLOTS = (3, 4, 5), 1 << 20
#: An n-gram is used if a 200th of the sample's documents have it, 5 to 15 at least, and its log ratio is at least so large.
MIN_DOCS, MIN_RATIO = (5, 15), 1.5
#: Code points hashed at once.
BLOCK = 1 << 20


def gram_stream(text: str | None) -> Iterator[np.ndarray]:
    """Slots of a text's n-grams with repeats, in arrays of at most BLOCK; n-grams run over lower-cased text with a space at both ends."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + max(GRAMS) - 1].astype(np.uint64)
        h = part
        for n in range(2, max(GRAMS) + 1):
            if len(part) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            if n in GRAMS:
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                yield ((mixed >> np.uint64(44)) & np.uint64(SLOTS - 1)).astype(np.int32)[:BLOCK]


def gram_slots(text: str | None, number: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct slots of a text's n-grams, or the distinct numbers >= 0 that `number` gives to them."""
    found = [np.empty(0, dtype=np.int32)]
    for slots in gram_stream(text):
        if number is not None:
            slots = number[slots]
            slots = slots[slots >= 0]
        found.append(np.unique(slots))
    return np.unique(np.concatenate(found))


def gram_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slots, log-count ratios) of the n-grams that tell the labels apart."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = np.zeros((2, SLOTS), dtype=np.int64)
        for pdf in parts:
            for text, y in zip(pdf["text"], pdf["y"]):
                docs[y, gram_slots(text)] += 1
        at = np.flatnonzero(docs.any(axis=0))
        yield pd.DataFrame({"slot": at, "n0": docs[0, at], "n1": docs[1, at]})

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0)
    counts = rows.select("text", "y").mapInPandas(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, q = (F.col("n1") + 1) / (total[1] + 2), (F.col("n0") + 1) / (total[0] + 2)
    ratio = F.log(p / q)
    least = min(max(MIN_DOCS[0], sum(total.values()) // 200), MIN_DOCS[1])
    kept = counts.filter((F.col("n0") + F.col("n1") >= least) & (F.abs(ratio) >= MIN_RATIO)).select("slot", ratio.alias("r")).orderBy("slot").toPandas()
    return kept["slot"].to_numpy(), kept["r"].to_numpy()


def fit_logistic(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, steps: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (scale included) and bias of a logistic regression on rows of feature numbers, by Adam with full gradients."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x) if len(rows) else np.empty(0, dtype=np.int64)
    value = scale[cols]
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.bincount(rows, value * w[cols], minlength=len(x)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gw, gb = np.bincount(cols, value * g[rows], minlength=len(w)) + l2 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w, b = w - rate * m / (np.sqrt(v) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000) -> dict:
    """The model: the number of each slot (-1: unused), weights by number, and a bias."""
    rows = keep(training_rows(docs, labels, label, max_rows), "toxicity-sample")  # documents are read once for it
    slots, ratios = gram_ratios(rows)
    number = np.full(SLOTS, -1, dtype=np.int32)
    number[slots] = np.arange(len(slots), dtype=np.int32)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"y": pdf["y"], "x": [gram_slots(t, number).tobytes() for t in pdf["text"]]})

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"y": [], "x": []}), *parts])  # the sample is bounded
        if len(rows):
            w, b = fit_logistic([np.frombuffer(v, dtype=np.int32) for v in rows["x"]], rows["y"].to_numpy(dtype=float), ratios)
            yield pd.DataFrame({"w": [w.astype("<f8").tobytes()], "b": [b]})

    fitted = rows.select("text", "y").mapInPandas(features, "y int, x binary").repartition(1).mapInPandas(fit, "w binary, b double").collect()
    w, b = (np.frombuffer(fitted[0]["w"], dtype="<f8"), fitted[0]["b"]) if fitted else (np.zeros(len(slots)), 0.0)
    return {"number": number, "weight": w * ratios, "bias": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column `score`, 0 to 1; an input column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            z = np.array([m["weight"][gram_slots(t, m["number"])].sum() + m["bias"] for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", scored(F.col("text")))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score of every document, learned from labelled documents that aren't held out; null and empty texts are scored as texts without n-grams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
