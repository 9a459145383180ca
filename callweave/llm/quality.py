"""Operator 8: quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled good and bad texts. A text is cut into pieces, each is
compressed with either dictionary and with none, and the difference of the sizes by the plain size,
summed over the text, tells which kind it is nearer to. A logistic curve fitted to labelled rows that the
dictionaries haven't seen turns it into a score.

At most `max_rows` labelled rows are learned from, those with the smallest hashed ids, and their texts are
read whole, those of a class in one task. Texts in which too little recurs for zstandard to choose from,
such as a few short ones, are the dictionary themselves.

Defined cases: null and empty texts have no difference and get the score that belongs to 0; whole
texts are scored; labels that are null or other than 0 and 1 are not learned from; with labels of one
class or none, in the sample or in the half that the curve is fitted to, the score is their smoothed share of class 1; repeated rows are scored each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep, table, training_rows

#: Bytes of a piece and of a dictionary.
PIECE, DICTIONARY = 512, 32_768
LEVEL = 3


def cut(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def dictionary(pieces: list[bytes]) -> bytes:
    """What recurs most in the pieces, or what there is of them."""
    size = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, size // 4), pieces, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:DICTIONARY]


def dictionaries(rows: DataFrame) -> dict[int, bytes]:
    """A dictionary for each class of rows(doc_id, text, y) that has text."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        in_order = pdf.sort_values(["doc_id", "text"])
        return pd.DataFrame({"y": pdf["y"].iloc[:1], "content": [dictionary([p for t in in_order["text"] for p in cut(t)])]})

    found = rows.groupBy("y").applyInPandas(train, "y int, content binary").collect()  # two rows
    return {r["y"]: bytes(r["content"]) for r in found if r["content"]}


def difference_of(docs: DataFrame, words: dict[int, bytes]) -> Column:
    """How much better the good dictionary compresses a text of docs than the bad one; 0 if there aren't both."""
    if len(words) < 2:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("double")
    def difference(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bad, good = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value[y]), write_content_size=False) for y in (0, 1))
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for texts in parts:
            out = []
            for text in texts:
                pieces = cut(text)
                sizes = [sum(len(c.compress(p)) for p in pieces) for c in (bad, good, plain)]
                out.append((sizes[0] - sizes[1]) / sizes[2])
            yield pd.Series(out, dtype=float)

    return difference(docs["text"])


def calibration(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton's method with slight shrinkage; with one class or none the smoothed share of class 1."""
    if not 0 < y.sum() < len(y):
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-4, 0]) * w)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000) -> dict:
    """The model: two dictionaries, slope and offset."""
    rows = keep(training_rows(docs, labels, label, max_rows), "quality-sample")  # documents are read once for it
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    words = dictionaries(rows.filter(half == 0))
    seen = rows.filter(half == 1).select(difference_of(rows, words).alias("difference"), "y").toPandas()  # max_rows pairs of numbers at most
    slope, offset = calibration(seen["difference"].to_numpy(dtype=float), seen["y"].to_numpy(dtype=float))
    return {"words": words, "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column `score`, 0 to 1; an input column of that name is replaced."""
    z = difference_of(docs, model["words"]) * model["slope"] + model["offset"]
    return docs.withColumn("score", 1 / (1 + F.exp(-z)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """A score of every document, learned from labelled documents that aren't held out; null and empty texts are scored as texts without a difference."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
