"""Cases of single operators and of the pipeline's stages, held against plain versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from callweave.llm import chat, decontaminate, embed_dedup, jaccard, mixing, pii, quality, queries, substring, token_binary, toxicity

DOCS = "doc_id long, text string"


def plain_spans(text):
    """Base spans by the forms as they are stated."""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(v):
        figures = [int(c) for c in reversed(v)]
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(figures)) % 10 == 0

    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(form, text) if ok(m[0])] for k, (form, ok) in forms.items()}


def test_base_spans_equal_plain_regexes(spark):
    rng = np.random.default_rng(2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    signs = list("0123456789") * 3 + list(".@+-() aZé\n") + ["4111111111111111", "10.0.0.1", "a@b.c"]
    rows += [(10_000 + i, "".join(rng.choice(signs, size=60))) for i in range(400)]
    rows += [(20_000, None), (20_001, ""), (20_002, "9" * 30_000 + "@"), (None, "a@b.org"), (5, "a@b.org"), (5, "a@b.org")]
    found = pii.find_personal_data(spark.createDataFrame(rows, DOCS).withColumn("n_spans", F.lit("clash")), min_texts=1, everywhere=True).collect()
    got = sorted(((r.doc_id or -1, *[tuple((s.start, s.end) for s in r[k]) for k in pii.KINDS]) for r in found), key=str)
    assert got == sorted(((i or -1, *[tuple(plain_spans(t or "")[k]) for k in pii.KINDS]) for i, t in rows), key=str)
    assert pii.find_personal_data(spark.createDataFrame([], DOCS), min_texts=1, everywhere=True).count() == 0


def test_a_name_that_goes_with_one_card_is_removed(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881"]
    texts = [f"the card {cards[0]} belongs to quillfeather", *[f"the card {c} belongs to common" for c in cards]]
    texts += ["write a@b.org to drum rarely", "drum letters go to a@b.org mostly", "drum alone"]
    texts += ["the office belongs to common letters and rarely write mostly card alone go"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = pii.find_personal_data(docs, min_texts=1, everywhere=True)
    terms = {r.doc_id: {(t.value, t.action) for t in r.terms} for r in found.filter("size(terms) > 0").collect()}
    drum = {("drum", "generalise")}
    assert terms == {0: {("quillfeather", "remove")}, 4: drum, 5: drum, 6: drum}
    clean = {r.doc_id: r.clean for r in pii.sanitise(found).collect()}
    assert clean[0] == "the card [card] belongs to " and clean[6] == "[term] alone" and clean[7] is None


def test_tokens_equal_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    signs = [*" \n\t'.,-!é😀ßaZ09", "  ", "word", " end", "'s", "<|endoftext|>", "\0"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, "".join(rng.choice(signs, size=40))) for i in range(600)]
    rows += [(20_000, "x <|endoftext|> y"), (20_001, None), (20_002, ""), (20_003, "long " * 60_000), (None, "no id")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash"))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_binary.read_tokens(token_binary.write_tokens(docs, path)).collect()))
    want, start = [], 0
    for i, text in sorted(((i if i is not None else -1, t) for i, t in rows), key=lambda r: r[0]):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_binary.read_tokens(token_binary.write_tokens(spark.createDataFrame([], DOCS), path)).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "Two words, don't  join"), (2, "a.b c")]
    got = {r.doc_id: r.n_tokens for r in token_binary.read_tokens(token_binary.write_tokens(spark.createDataFrame(rows, DOCS), path)).collect()}
    plain = Tokenizer.from_file(path)
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_repeated_ids_take_tokens_each(spark):
    rows = token_binary.read_tokens(token_binary.write_tokens(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b c")], DOCS), public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert sorted((r.start, r.n_tokens) for r in rows)[0][0] == 0 and sum(r.n_tokens for r in rows) == 7 and len(rows) == 3


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, module, label):
    docs = spark.createDataFrame([(i, f"some text {i} " * 9) for i in range(40)] + [(40, None), (41, ""), (41, ""), (None, "x")], DOCS).withColumn("label", F.lit("clash"))
    share = lambda n1, n: (n1 + 1) / (n + 2)
    learned = [i for i in range(42) if zlib.crc32(str(i).encode()) % 5]
    for y, expected in ((1, None), (0, None), (None, 0.5)):
        labels = spark.createDataFrame([(i, y) for i in range(42)], f"doc_id long, {label} int")
        scores = {r.score for r in module.score(docs, module.train(docs, labels)).collect()}
        assert len(scores) == 1 and all(0 <= s <= 1 for s in scores)
        assert expected is None or scores == {expected}
        assert y is None or (next(iter(scores)) > 0.5) == (y == 1)
    one_each = spark.createDataFrame([(learned[0], 1), (learned[1], 0)], f"doc_id long, {label} int")
    assert all(0.02 < r.score < 0.98 for r in module.score(docs, module.train(docs, one_each)).collect()) and share(0, 0) == 0.5
    assert module.score(docs.limit(0), module.train(docs.limit(0), one_each)).count() == 0


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_rows_are_ranked(spark, module, label):
    """The area under the curve, which no constant answer raises above a half."""
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = module.score(docs, module.train(docs, labels))
    rows = scored.join(labels.filter(F.col(label).isNotNull()), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", label).collect()
    good, bad = ([r.score for r in rows if r[label] == y] for y in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.9


def test_typed_parts_of_a_chat(spark):
    parts = [("text", "see <a>\\", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", 3), ("document", None, None, None), ("odd kind", "x", "r", 7), (None, "end", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None), ("image", None, "o.png", None), ("text", " ok", None, None)]), (None, 0, None, None), (1, 1, "assistant", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    out = {(r.conv_id, r.turn, len(r.attachments)): r for r in chat.format_turns(turns).collect()}
    first, answer = out[(1, 0, 4)], out[(1, 1, 1)]
    assert first.piece == "<turn user>see \\la>\\b<image/><audio/><document/><odd_kind/>end</turn>\n" and not first.spans
    assert [(a.type, a.ref, a.tokens) for a in first.attachments] == [("image", "i.png", 512), ("audio", "a.wav", 75), ("document", None, 400), ("odd kind", "r", 0)]
    assert first.n_tokens == 2 + 512 + 75 + 400 + 1
    assert [answer.piece[s.start : s.end] for s in answer.spans] == ["yes", " ok"] and answer.n_tokens == 2 + 256
    back = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert back == {1: (3, 6), None: (1, 0)}
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_mixing_of_odd_rows_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(6000)] + [(6000, None, "a"), (6001, "", None), (6001, "", None), (None, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("size", F.lit(-1))
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == len(rows)
    for r in mixed.groupBy("row.source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("copies").alias("most"), F.first("source_size").alias("size")).collect():
        assert r.most <= 2 and r.t <= 2 * r.size and (r.size < 100 or abs(r.n - r.t) <= 0.05 * r.t)
    assert mixing.emit(mixed).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_empty_tables_and_clashing_names(spark):
    bench = spark.createDataFrame([("1", "one two"), ("1", "one two"), (None, "three four"), ("2", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero ONE two three four"), (1, "zero ONE two three four"), (None, "one")], DOCS).withColumn("n_hit", F.lit("clash"))
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r["items"])) for r in rows) == [(-1, 1, 0, ()), (1, 5, 4, ("1",)), (1, 5, 4, ("1",))]
    empty = spark.createDataFrame([], DOCS)
    assert decontaminate.decontaminate(empty, bench).count() == 0 and substring.remove_repeats(empty).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    assert sorted((r.vec_id or -1, r.n_links) for r in embed_dedup.near_duplicates(vectors).collect()) == [(-1, 0), (1, 1), (1, 1)]
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_repeats_of_a_null_id_and_of_a_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{passage} null")] + [(i, f"a{i} b{i} {passage} z{i}") for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {None: (31, 0), **{i: (33, 30) for i in range(60)}}


@pytest.mark.parametrize("parts", [1, 3])
def test_substring_dedup_equals_brute_force(spark, parts):
    """Passages that most documents hold, whole, in part, twice and at odd places; copies; runs of one word."""
    dice = random.Random(7)
    hot = [f"h{i}" for i in range(70)]
    texts = []
    for i in range(240):
        a = dice.randrange(0, 40)
        some = hot if i % 3 else hot[a : a + dice.randrange(10, 31)]
        own = [f"o{i}x{k}" for k in range(dice.randrange(0, 30))]
        at = dice.randrange(len(own) + 1)
        words = own[:at] + some + own[at:] + (some if i % 5 == 0 else [])
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], "r " * 50, "r " * 45 + "s", " ".join(hot[:19]), ""]
    dice.shuffle(texts)
    seen, want = set(), {}
    for i, text in enumerate(texts):
        words = text.split()
        gone = set()
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone |= set(range(at, at + 20))
            seen.add(window)
        want[i] = (len(words), " ".join(w for at, w in enumerate(words) if at not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts)
    got = {r.doc_id: (r.n_words, r.kept) for r in substring.remove_repeats(docs).collect()}
    assert got == want


def test_windows_that_differ_in_one_word_of_a_like_hash(spark):
    """Two words whose 64-bit hashes agree in their lower half, at any place of a window."""
    half, pair = {}, None
    for i in range(10_000_000):
        pair = half.setdefault(xxhash.xxh64_intdigest(f"w{i}") & 0xFFFFFFFF, i), i
        if pair[0] != i:
            break
    one, other = (f"w{i}" for i in pair)
    rows = []
    for at in range(20):
        for n, word in enumerate((one, other)):
            words = [f"p{at}x{k}" for k in range(20)]
            words[at] = word
            rows.append((2 * at + n, " ".join(words)))
    docs = spark.createDataFrame([*rows, (100, rows[0][1] + " end")], DOCS)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect() if r.n_removed} == {100: 20}


def test_pipeline_stages(spark):
    """Each stage on its own input against a plain version of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (None, "a b c d e f g"), (900_003, "a b c d e f g"), (900_003, "a b c d e f g")], DOCS)
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("row", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("hash", F.lit("clash")).cache()
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, SF)
    scored = queries.QUERIES["op10_toxicity"](spark, SF).filter("predicted = 0")
    assert kept.columns == docs.columns and len(ids(kept)) > 0.8 * docs.count()
    assert set(ids(scored)) - set(ids(kept)) == set() and kept.filter("doc_id > 900000").count() == 4

    kept = stages["ngram_jaccard"](spark, docs, SF)
    groups = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    want = sorted({-1} | {i for i, c in groups.items() if i is not None and i == c})
    assert kept.columns == docs.columns and ids(kept) == want

    kept = stages["decontamination"](spark, docs, SF)
    hit = {r.doc_id for r in queries.QUERIES["op1_decontaminate"](spark, SF).filter("contaminated").collect()}
    assert kept.columns == docs.columns and ids(kept) == [i for i in ids(docs) if i not in hit]

    kept = stages["mixing"](spark, docs, SF)
    copies = {}
    for r in mixing.mix(docs).select("doc_id", "copies").collect():
        copies[r.doc_id if r.doc_id is not None else -1] = copies.get(r.doc_id if r.doc_id is not None else -1, 0) + r.copies
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i, n in copies.items() for _ in range(n))

    out = stages["token_binary"](spark, docs, SF)
    assert ids(out) == ids(docs)


def test_cells_leave_the_worker_as_one_row_a_vector(spark):
    """In a dense cloud each vector visits most cells: the copies are made by Spark, not inside of a task's frame."""
    rng = np.random.default_rng(3)
    cloud = rng.normal(scale=0.03, size=(2_000, 16)) + np.eye(16)[0]
    reps = spark.createDataFrame([(1, v, i, 1) for i, v in enumerate(cloud.tolist())], "label int, embedding array<double>, id long, n long")
    placed = embed_dedup.cells(reps, 0.93)
    assert placed.count() > 5 * 2_000 and placed.select("id", "cell").distinct().count() == placed.count()
    assert placed.filter("home = cell").count() == 2_000
    assert "Generate explode(cells" in placed._jdf.queryExecution().executedPlan().toString()
