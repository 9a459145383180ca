"""Operators 11 to 13, and what was mended in others: against plain versions, and in their defined cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import chat, collocations, periodic, pii, quality, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# Collocations


def plain_phrases(rows, least, most, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang or "und"] += len(words)
            for i in range(len(words)):
                for n in range(1, min(most, len(words) - i) + 1):
                    counts[lang or "und"][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {w for w, n in f.items() if n >= least and len(w) > 1}
        inner = collections.Counter()
        for w in found:
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    inner[w[i : i + n]] = max(inner[w[i : i + n]], f[w])
        scored = []
        for w in found:
            score, k = min((1000 * f[w] * totals[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            if 100 * inner[w] < 100 * f[w]:
                scored.append((-score, -f[w], " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, totals[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).repartition(3)
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


def some_text(rng, n):
    words = ["a", "B", "c", "d", "é", "x\x1cy", "long-word", "0"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r"]) for _ in range(n))


def test_collocations_are_those_of_plain_counting(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, "und"]), some_text(rng, rng.randint(0, 60))) for _ in range(300)] + [(None, None), ("en", ""), ("fr", "x y")]
    rows += [("en", "same phrase of five words again")] * 40
    want = plain_phrases(rows, 12, 5, 50)
    assert len(want) > 60 and mined(spark, rows, least=12, top=50) == want
    # Small blocks, small batches and hot words: counts in parts are added up.
    for name, value in (("BLOCK", 40), ("HOT", 1 << 20), ("REMEMBERED", 30), ("AT_ONCE", 200), ("COUNTED", 500)):
        monkeypatch.setattr(collocations, name, value)
    assert mined(spark, rows, least=12, top=50) == want


def test_collocations_without_any(spark):
    assert mined(spark, [], least=2) == [] and mined(spark, [("en", "one"), (None, None)], least=1) == []
    assert mined(spark, [("en", "a b")] * 3, least=3) == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_quicksort_abandons_what_is_infrequent():
    import pyarrow as pa

    found = dict(collocations.quicksorted(pa.array(["a b c", "a b", "a", "b c", "a b d"]), np.array([2, 3, 1, 4, 1]), 1, 4))
    assert found == {"a": 7, "a b": 6, "b": 4, "b c": 4}


# Periodic runs


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n, k):
    words = []
    while len(words) < n:
        part = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        words += (part * rng.randint(1, 30))[: rng.randint(1, 150)]
    return words[:n]


def test_runs_are_those_of_plain_search():
    rng = random.Random(7)
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([0, 1, 5, 6, 7, 40, 300]), rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 9))]
        assert periodic.runs_of([np.array(t, dtype=np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_longest_common_extensions():
    rng = np.random.default_rng(2)
    words = np.append(np.tile(rng.integers(0, 3, 90), 12), 99)
    i, j = (rng.integers(0, len(words) - 1, 500) for _ in range(2))
    i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = i[i < j], j[i < j]
    want = [next(t for t in range(len(words)) if b + t >= len(words) or words[a + t] != words[b + t]) for a, b in zip(i, j)]
    assert periodic.Extensions(words, np.zeros(len(words), dtype=np.int64))(i, j).tolist() == want


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    at, n = list(range(len(words))), len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        at = [i if i < a else a + (i - a) % p for i in range(n)]
    words = [words[i] for i in at]
    runs, gone = plain_runs(words), set()
    for s, length, p in runs:
        gone |= set(range(s + p, s + length))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, digest("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_is_plain_search_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, SF).collect())) == sorted(plain_row(*r) for r in docs)


def test_runs_in_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 5)
    rows = [(1, "a b " * 4), (1, "a b " * 4), (None, "x " * 6), (2, None), (3, ""), (4, "word"), (5, "n " * 3000), (6, "b\x1ca b\x1ca b\x1ca b\x1ca b\x1ca b\x1ca")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()), key=str)
    want = [(1, 8, [(0, 8, 2)], "a b")] * 2 + [(0, 6, [(0, 6, 1)], "x"), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "word"), (5, 3000, [(0, 3000, 1)], "n"), (6, 6, [(0, 6, 1)], "b\x1ca")]
    assert got == sorted(want, key=str)
    assert periodic.find_runs(docs.limit(0)).count() == 0


# Sharding


def test_packing_goes_where_the_product_is_highest():
    items = np.array([[0.3, 0.1], [0.1, 0.3], [0.3, 0.3], [0.3, 0.3]])
    left = np.full((2, 2), 0.5)
    assert sharding.highest(left, items).tolist() == [0, 1, 0, 1] and np.allclose(left.sum(), 0, atol=0.01)


@pytest.fixture(scope="module")
def shards(spark):
    return queries.QUERIES["op13_shards"](spark, SF).toPandas()


def test_op13_shards_are_even_and_whole(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.itertuples()}
    assert {r.doc_id: (r.size_, r.text_crc32) for r in shards.rename(columns={"size": "size_"}).itertuples()} == want
    sums = shards.groupby("shard").agg(size=("size", "sum"), words=("words", "sum"), n=("slot", "size"), top=("slot", "max"), slots=("slot", "nunique"))
    assert list(sums.index) == list(range(16)) and (sums.slots == sums.n).all() and (sums.top == sums.n - 1).all()
    assert sums["size"].max() < 1.08 * sums["size"].mean() and set(shards.law) == {"bytes"} and shards.grown_shard.isna().all()
    assert shards.sort_values(["shard", "slot"]).groupby("shard").doc_id.apply(lambda s: s.is_monotonic_increasing).all()
    again = queries.QUERIES["op13_shards"](spark, SF).toPandas()
    assert sorted(map(tuple, again[["doc_id", "shard", "slot"]].to_numpy())) == sorted(map(tuple, shards[["doc_id", "shard", "slot"]].to_numpy()))


def test_groups_stay_together_unless_no_shard_holds_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "LANE", 50)
    rows = [(i, f"text {i % 400} " + "w " * (i % 37)) for i in range(2000)] + [(9000 + i, "hot " * 30) for i in range(1000)]
    rows += [(None, None), (None, ""), (-1, ""), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).repartition(5)
    found = sharding.pack(docs, 4).toPandas()
    assert len(found) == len(rows)
    by = found.groupby(["hash", "text_crc32", "size"]).shard.nunique()
    hot = len("hot " * 30) + 1
    assert (by[by.index.get_level_values("size") != hot] == 1).all() and by[by.index.get_level_values("size") == hot].max() > 1
    for c in ("size", "words"):
        assert found.groupby("shard")[c].sum().max() < 1.02 * found[c].sum() / 4
    assert found.groupby("shard").size().max() < 1.02 * len(rows) / 4
    path = sharding.write_shards(docs, str(tmp_path / "out"), 4, 2)
    back = spark.read.parquet(path).toPandas()
    assert len(back) == len(rows) and set(back.shard) == {"clash"}
    assert back.groupby("_shard").size().tolist() == found.groupby("shard").size().tolist()
    assert sharding.pack(docs.limit(0)).count() == 0


# What was mended


def test_a_few_short_texts_tell_classes_apart(spark):
    rows = [(i, f"alpha beta gamma delta {i % 7}" if i % 2 else f"kuku lulu momo nunu {i % 5}") for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("difference", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert "difference" in scored.columns
    score = {r.doc_id: r.score for r in scored.collect()}
    assert min(score[i] for i in range(1, 60, 2)) > 0.8 > 0.2 > max(score[i] for i in range(0, 60, 2)) and score[100] == score[101]


def test_op8_is_plain_compression(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.select("doc_id", "quality"))
    sized = {y: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(c), write_content_size=False) for y, c in model["words"].items()}
    bare = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def plain(text):
        data = (text or "").encode()
        pieces = [data[i : i + 512] for i in range(0, len(data), 512)] or [b""]
        size = lambda c: sum(len(c.compress(p)) for p in pieces)
        return 1 / (1 + np.exp(-(model["slope"] * (size(sized[0]) - size(sized[1])) / size(bare) + model["offset"])))

    got = {r.doc_id: r.score for r in queries.QUERIES["op8_quality"](spark, SF).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == pytest.approx(plain(r.text), abs=1e-9)


def test_turns_that_tie_go_by_their_texts(spark):
    texts = ["<", "=", "\\", "]", "a", "a b", "", "<<"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn int, role string, text string")
    want = hashlib.sha256("".join(f"user\n{t}\n" for t in sorted(texts, key=str.encode)).encode()).hexdigest()
    assert chat.read_back(chat.format_turns(turns)).first().turns_sha256 == want


def test_long_texts_with_many_places(spark):
    """Contexts over the ends of blocks, spans across them, and thousands of places in one text."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(9000)]
    for k in range(0, 9000, 9):
        words[k] = rng.choice([f"u{k}@mail.org", "10.0.0.7", "+49 30 1234567", "4111 1111 1111 1111"])
    text = " ".join(words)
    found = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "nothing")], DOCS), min_texts=1, everywhere=True)
    row = found.filter("doc_id = 1").first()
    marks = sorted([(s.start, s.end, f"[{k}]") for k in pii.KINDS for s in row[k]] + [(t.start, t.end, None) for t in row.terms])
    assert len(row.email) > 150 and all(text[s.start : s.end] == s.value for k in pii.KINDS for s in row[k]) and all(text[t.start : t.end] == t.value for t in row.terms)
    assert [s.value for s in row.email] == re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)
    by = {(t.start, t.end): t for t in row.terms}
    sort = lambda v: "[number]" if v.isdigit() else "[name]" if v[0].isupper() else "[term]"
    want, at = [], 0
    for a, b, mark in marks:
        want += [text[at:a], mark if mark else "" if by[(a, b)].action == "remove" else sort(by[(a, b)].value)]
        at = b
    clean = {r.doc_id: r.clean for r in pii.sanitise(found).collect()}
    assert clean == {1: "".join([*want, text[at:]]), 2: None}


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in ("of", "key", "row", "hash", "score", "difference", "taken")})
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def plain_slots(text):
    points, top = [ord(c) for c in f" {(text or '').lower()} "], 1 << 64
    out = set()
    for n in toxicity.GRAMS:
        for i in range(len(points) - n + 1):
            h = points[i]
            for p in points[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + p) % top
            out.add((((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) % top >> 44) % toxicity.SLOTS)
    return sorted(out)


def test_op10_is_a_plain_sum_of_weights(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    # The ratios that scale the features, counted plainly.
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    counts, total = (collections.Counter(), collections.Counter()), collections.Counter(known[i] for i in known if i in texts)
    for i in known:
        if i in texts:
            counts[known[i]].update(plain_slots(texts[i]))
    least = min(max(toxicity.MIN_DOCS[0], sum(total.values()) // 200), toxicity.MIN_DOCS[1])
    ratio = {s: np.log(((counts[1][s] + 1) / (total[1] + 2)) / ((counts[0][s] + 1) / (total[0] + 2))) for s in {*counts[0], *counts[1]} if counts[0][s] + counts[1][s] >= least}
    kept = sorted(s for s, r in ratio.items() if abs(r) >= toxicity.MIN_RATIO)
    assert np.flatnonzero(model["number"] >= 0).tolist() == kept
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    for i, text in texts.items():
        z = sum(model["weight"][model["number"][s]] for s in plain_slots(text) if model["number"][s] >= 0) + model["bias"]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
