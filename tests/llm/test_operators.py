import itertools
import re

import duckdb
import numpy as np
import pytest
from conftest import SF, compare
from pyspark.sql import functions as F

from callweave.llm import components, decontaminate, embed_dedup, jaccard, mixing, pii, quality, queries, substring, toxicity

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def words_of(n, start=0):
    return [f"w{start + i}" for i in range(n)]


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and a column with a clashing name."""
    long_ = " ".join(words_of(30000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "  "), (5, long_), (6, long_ + " tail"), (7, "A B C D E F"), (None, "a b c d e f"), (8, "x")]
    return spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))


def jaccard_brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}


def test_jaccard_on_odd_documents(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd_documents(spark)).collect()}
    assert got == {(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 29996, 5), (6, 29997, 5), (7, 2, 1), (None, 2, 1), (8, 1, 8)}
    assert jaccard.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_jaccard_equals_brute_force_near_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"f{family}x{i}" for i in range(60 + 90 * family)]
        for member in range(8):
            w = list(base)
            for at in rng.choice(len(w), size=max(1, int(len(w) * 0.006 * member)), replace=False):
                w[at] = f"m{member}"
            rows.append((len(rows), " ".join(w)))
    links = jaccard_brute(rows)
    low = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == dict(enumerate(low))


def test_jaccard_of_a_large_group_equals_brute_force(spark, monkeypatch):
    """Near copies that fill several blocks and several tasks' shares of a shingle, in two groups that share a passage."""
    monkeypatch.setattr(jaccard, "DEALT", 300)
    rng = np.random.default_rng(11)
    passage, rows = [f"p{i}" for i in range(12)], []
    for i in range(1300):
        w = passage + [f"g{i % 2}x{k}" for k in range(48)]
        for at in rng.choice(len(w), size=int(rng.integers(0, 4)), replace=False):
            w[at] = f"r{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(56)) for _, t in rows]
    low = np.arange(len(rows))
    near = np.array([[100 * (c := len(a & b)) >= 80 * (len(a) + len(b) - c) for b in sets] for a in sets])
    while (nxt := np.where(near, low[None, :], len(rows)).min(axis=1)).tolist() != low.tolist():
        low = nxt
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: int(x) for i, x in enumerate(low)} and len(set(got.values())) > 2


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(components, "range", lambda n: (0,), raising=False)  # a bound of one round
    path = [7, 2, 9, 4, 11, 1, 8, 5, 10, 3, 6, 0]
    edges = spark.createDataFrame(list(itertools.pairwise(path)), "a long, b long")
    assert {(r.id, r.component) for r in components.components(edges).collect()} == {(i, 0) for i in path}


def test_embeddings_equal_brute_force(spark):
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op5_embed_dedup"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    v = np.array([r[1] for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    same = np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    near = (v @ v.T >= 0.93) & same & ~np.eye(len(rows), dtype=bool)
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(near, low[None, :], len(rows)).min(axis=1))
    assert got == {r[0]: (int(near[i].sum()), rows[low[i]][0]) for i, r in enumerate(rows)}


def test_embeddings_with_bad_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (8, [1.0, None], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in range(3, 9)}}


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 50])
def test_embeddings_of_one_wide_label_equal_brute_force(spark, monkeypatch, block):
    """A low-rank cloud that k-means cuts along its widest axes into many cells, of one block and of several."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(6000, 64)) / np.arange(1, 65) ** 1.75).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    low = np.arange(len(u))
    while (nxt := np.minimum(low, np.where(near, low[None, :], len(u)).min(axis=1))).tolist() != low.tolist():
        low = nxt
    assert got == {i: (int(near[i].sum()), int(low[i])) for i in range(len(u))}


def test_personal_data(spark):
    docs = spark.createDataFrame([(1, "é mail a.b@c.example.org now, ip 10.0.0.255 or 300.1.1.1"), (2, "card 4111 1111 1111 1111 or 4111 1111 1111 1112 call +49 (30) 1234-567"), (3, None), (4, "")], DOCS)
    got = {r.doc_id: tuple(len(r[k]) for k in ("email", "ip", "card", "phone")) for r in pii.find_personal_data(docs).collect()}
    assert got == {1: (1, 1, 0, 0), 2: (0, 0, 1, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}


def test_terms_that_reveal_personal_data(spark):
    texts = [
        "please write to a@b.org about zephyrine and the umbrage soon", "the zephyrine umbrage office answers under a@b.org every day",
        "one umbrage more without any address",
        "copied text gives c@d.org and quixotry today", "copied text gives c@d.org and quixotry today", "Copied text gives c@d.org and quixotry today",
        "first e@f.org with perigee here and then once more perigee at e@f.org again",
    ] + ["please write to the office about any address and answers under copied text every day soon"] * 193
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: {(t.value, t.action) for t in r.terms} for r in pii.find_personal_data(docs).filter("size(terms) > 0").collect()}
    both = {("zephyrine", "remove"), ("umbrage", "generalise")}
    assert got == {0: both, 1: both}
    clean = {r.doc_id: r.clean for r in pii.sanitise(pii.find_personal_data(docs)).collect()}
    assert clean[0] == "please write to [email] about  and the [term] soon" and clean[3] == "copied text gives [email] and quixotry today"


def test_decontamination_and_repeats_on_odd_documents(spark):
    bench = spark.createDataFrame([(1, " ".join(words_of(12, 100))), (2, "x"), (3, None)], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(odd_documents(spark).filter("doc_id is not null"), bench).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 0, 5: 12, 6: 12, 7: 0, 8: 1}
    kept = {r.doc_id: r.n_removed for r in substring.remove_repeats(odd_documents(spark).filter("doc_id > 1")).collect()}
    assert kept == {2: 0, 3: 0, 4: 0, 5: 0, 6: 30000, 7: 0, 8: 0}


def test_mixing_repeats_itself_and_keeps_to_its_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "copies").collect())) for _ in range(2))
    assert first == again and all(0 <= copies <= 2 for _, _, copies in first)


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(spark, module, label, cut):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = module.score(docs, module.train(docs, labels))
    rows = scored.join(labels.filter(F.col(label).isNotNull()), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", label).collect()
    assert np.mean([(r.score >= cut) == (r[label] == 1) for r in rows]) >= 0.85
