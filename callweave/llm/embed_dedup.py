"""Operator 5: near-duplicates among embeddings, by spherical k-means and blocked cosine products.

Vectors of one label are compared. Equal vectors are one class, which is compared once. Spherical
k-means, fitted to a bounded sample of each label, gives each vector its home cell. Two unit vectors
of cosine c are at most sqrt(2 - 2c) apart. If they are at home in two cells, the plane between both
centres lies between them, so that their distances from it add up to no more than that and one of the
two is within half of it. A vector visits the cells whose planes are that near, and each link is found
where one of its ends is at home: none is lost. Two visitors of a cell needn't be compared there.
Cells are multiplied in blocks; each block tells how many links a vector has and joins the linked
ones, and the pieces are put together by connected components. One representative of each component,
its smallest id, is kept.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
without label or id, link with nothing; vectors of different lengths neither; rows that repeat an id
are vectors of their own and get the same component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table
from .components import Forest, components

#: Vectors of a label in the sample, and for each cell; vectors of a task's group, of a slice of it, and of a block.
SAMPLE, CELL, GROUP, SLICE, BLOCK = 4_096, 256, 20_000, 1_024, 2_048
MAX_CELLS = SAMPLE // 16


def units(values) -> np.ndarray:
    v = np.stack([np.asarray(x, dtype=np.float64) for x in values])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(v: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k unit centres; starts from vectors spread over v, which is in a fixed order."""
    centres = v[np.unique(np.linspace(0, len(v) - 1, k).astype(int))]
    for _ in range(steps):
        home = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def classes(rows: DataFrame) -> DataFrame:
    """Valid rows(vec_id, embedding, label) -> one row for each different vector of a label: id (the smallest), n, embedding."""
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))


def valid(embedding: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def cells(reps: DataFrame, threshold: float) -> DataFrame:
    """reps(label, embedding, id, n) -> (label, dim, cell, home, visits, id, n, embedding), with a row for each visited cell; visits: a bit for each cell."""
    reps = reps.withColumn("dim", F.size("embedding"))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size"))
    chance = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(float(1 << 20)) * SAMPLE / F.col("size"))
    sample = reps.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["label", "dim"]).filter(chance)
    sample = sample.select("label", "dim", "size", "id", "embedding")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        k = max(1, min(MAX_CELLS, -(-int(pdf["size"].iloc[0]) // CELL), len(pdf)))
        centres = spherical_kmeans(units(pdf["embedding"]), k)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "centres": [centres.tobytes()], "groups": [-(-int(pdf["size"].iloc[0]) // GROUP)]})

    label = sample.schema["label"].dataType.simpleString()
    centres = keep(sample.groupBy("label", "dim").applyInPandas(fit, f"label {label}, dim int, centres binary, groups int"), "centres")
    dealt = reps.join(centres.select("label", "dim", "groups"), ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    to = centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    # Of two linked vectors on both sides of a plane the nearer one is at most half their distance from it.
    reach = float(np.sqrt(2 - 2 * threshold)) / 2 + 1e-9
    columns = ["label", "dim", "cells", "home", "visits", "id", "n", "embedding"]

    def assign(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(centre):
            return pd.DataFrame({c: [] for c in columns})
        dim = int(centre["dim"].iloc[0])
        c = np.frombuffer(centre["centres"].iloc[0], dtype=np.float64).reshape(-1, dim)
        near = units(rows["embedding"]) @ c.T
        home = near.argmax(axis=1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        # A row for each vector, whatever it visits; a slice at a time, as distances to all cells are much larger.
        told, visits = [], []
        for at in range(0, len(rows), SLICE):
            some, own = near[at : at + SLICE], home[at : at + SLICE]
            visited = some[np.arange(len(some)), own][:, None] - some <= reach * apart[own] + 1e-12
            told += [np.flatnonzero(v).astype(np.int32) for v in visited]
            visits += [v.tobytes() for v in np.packbits(visited, axis=1)]
        return rows[["label", "dim", "id", "n", "embedding"]].assign(cells=told, home=home.astype(np.int32), visits=visits)[columns]

    schema = f"label {label}, dim int, cells array<int>, home int, visits binary, id long, n long, embedding {reps.schema['embedding'].dataType.simpleString()}"
    placed = dealt.select("label", "dim", "part", "id", "n", "embedding").groupBy("label", "dim", "part").cogroup(to.groupBy("label", "dim", "part")).applyInPandas(assign, schema)
    return placed.select("label", "dim", F.explode("cells").alias("cell"), "home", "visits", "id", "n", "embedding")


def links(placed: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root): from each pair of blocks of a cell, links of ids that are counted there, and a linked id to join with; only ids that have either."""
    placed = keep(placed, "cells")
    at_home = F.col("home") == F.col("cell")
    in_blocks = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    blocks = placed.groupBy("label", "dim", "cell").agg(in_blocks(at_home).alias("homes"), in_blocks(~at_home).alias("visitors")).filter("homes > 0")
    # Blocks of those at home come first and meet all blocks; visitors meet those at home only.
    block = F.when(at_home, F.pmod(F.xxhash64("id"), F.col("homes"))).otherwise(F.col("homes") + F.pmod(F.xxhash64("id"), F.col("visitors")))
    dealt = placed.join(blocks, ["label", "dim", "cell"]).withColumn("block", block.cast("int"))
    met = F.col("homes") + F.when(at_home, F.col("visitors")).otherwise(0)
    other = F.explode(F.sequence(F.lit(0), met - 1)).alias("other")
    dealt = dealt.select("label", "dim", "cell", "block", "home", "visits", "id", "n", "embedding", other)
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("id").reset_index(drop=True)
        v, n, block = units(pdf["embedding"]), pdf["n"].to_numpy(), pdf["block"].to_numpy()
        home, cell = pdf["home"].to_numpy(), pdf["cell"].iloc[0]
        visits = np.unpackbits(np.stack([np.frombuffer(x, dtype=np.uint8) for x in pdf["visits"]]), axis=1).astype(bool)
        own = home == cell
        count, forest = np.zeros(len(pdf), dtype=np.int64), Forest(len(pdf))
        rows, cols = np.flatnonzero(block == first), np.flatnonzero(block == last)

        def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether x counts its link with y here: at home, or where y is at home that doesn't visit the home of x."""
            return own[x][:, None] | (own[y][None, :] & ~visits[np.ix_(y, home[x])].T)

        # The first block is at home. Two visitors meet where one of them is at home.
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            near = v[some] @ v[cols].T >= threshold
            near[some[:, None] == cols[None, :]] = False
            count[some] += (near & counts(some, cols)) @ n[cols]
            if first != last:
                count[cols] += (near.T & counts(cols, some)) @ n[some]
            for i, line in zip(some, near):
                found = cols[line]
                if len(found):
                    # Only ids that aren't yet together are joined.
                    for r in np.unique(forest.up[found]):
                        forest.join(int(i), int(r))
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({"id": ids, "links": count, "root": ids[forest.roots()]})
        return out[(out["links"] > 0) | (out["root"] != out["id"])]

    return dealt.groupBy("label", "dim", "cell", "i", "j").applyInPandas(multiply, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, with a row for each vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = rows.withColumn("valid", valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    able = rows.filter("valid")
    reps = keep(classes(able), "vectors")
    found = keep(links(cells(reps.select("label", "embedding", "id", "n"), threshold), threshold), "links")
    n_links = found.groupBy("id").agg(F.sum("links").alias("links"))
    together = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    told = reps.join(n_links, "id", "left").join(together, "id", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = able.select("vec_id", "embedding", "label").join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each vector: its links, its component, and whether it is the one that is kept; vectors that can't be compared are kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm)),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good AS a JOIN good AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON l.x = r.y),
component AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN component AS c ON c.x = vec_id LEFT JOIN counts AS k ON k.x = vec_id
"""
