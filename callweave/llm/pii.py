"""Operator 2: personal data, with information-theoretic sanitisation. DataFrame functions only.

Four kinds of protected entities are found by their form. Corpus co-occurrence then tells how
strongly a term reveals an entity: with documents as events, a term t in the context of entity c
(so many words on both sides) discloses it as far as its pointwise mutual information nears the
information content of c, which is reached if t never occurs without c. Terms beyond the higher threshold
are removed, those beyond the lower one generalised. Where the lower threshold alone is passed a term must
stand in two different contexts of an entity, in texts that differ in more than case: one text, however
often it is copied, proves nothing there. `min_texts` 2 asks the same of terms to be removed; with 1 a term
that never occurs without an entity goes, even if the entity occurs once. Terms are acted on in documents
that hold the entity, or with `everywhere` in all of them, as a term that discloses does so wherever it stands.

Contexts are the six words on each side within 120 characters; a term has three letters or digits at least.

Defined cases: a null text is empty; whole texts are read; a match that fails its check is dropped
and not tried again; terms that overlap a base span are left to it; repeated rows are returned each
and count once; a null doc_id is an id like another; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small, table

#: Kinds in the order of digests, with a sign that a text can hold one, and their forms. Possessive
#: repetition and a start that is no continuation keep matching linear and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Words of context on each side, and characters searched for them.
CONTEXT_WORDS, CONTEXT_CHARS = 6, 120
#: Shares of an entity's information content that a term must carry to be removed, and to be generalised.
REMOVE, GENERALISE = 1.0, 0.9
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'-]{2,}"
#: Broadcast up to so many disclosing terms, candidates or documents with spans, and so many bytes of them.
SMALL_TERMS = 200_000
#: Characters of a block, in which a text is searched by places; more than CONTEXT_CHARS.
BLOCK = 1000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda x: x.cast("int"))
    doubled = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def matches(text: Column, form: Column, kind: str) -> Column:
    """Matches of a form in order: array of (kind, at: their number, gap: characters since the one before, value)."""
    both = F.arrays_zip(F.split(text, form, -1).alias("gap"), F.regexp_extract_all(text, form, F.lit(0)).alias("value"))
    found = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.char_length(x["gap"]).cast("long").alias("gap"), x["value"].alias("value")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def located(found: DataFrame) -> DataFrame:
    """found(doc, kind, at, gap, value, ...) -> (doc, kind, start, end, value, ...), in code points: sums over the matches of a document, so that a text with many of them costs no more than others of that length."""
    once = found.repartition("doc", "kind").dropDuplicates(["doc", "kind", "at"])  # rows that repeat a document
    end = F.sum(F.col("gap") + F.char_length("value")).over(Window.partitionBy("doc", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value")).drop("at", "gap")


def signs(text: Column) -> dict[str, Column]:
    """Whether a text can hold a span of a kind."""
    return {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}


def base_spans(signed: DataFrame) -> DataFrame:
    """signed(doc, text) -> (doc, kind, start, end, value) of base spans."""
    none = F.array().cast("array<struct<kind:string,at:int,gap:bigint,value:string>>")
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    can = signs(F.col("text"))
    each = F.concat(*[F.when(can[k], matches(F.col("text"), F.lit(form), k)).otherwise(none) for k, form in forms.items()])
    found = located(signed.select("doc", F.explode(each).alias("x")).select("doc", "x.*"))
    v = F.col("value")
    octets = F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]|[0-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    card = F.char_length(digits(v)).between(16, 19) & luhn(digits(v))
    good = F.when(F.col("kind") == "ip", octets).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", F.char_length(digits(v)).between(8, 15)).otherwise(True)
    return found.filter(good)


def blocks(texts: DataFrame) -> DataFrame:
    """texts(doc, text) -> (doc, block, part): a text in parts of BLOCK characters, so that none is searched from its begin again and again."""
    parts = texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "part"))
    return parts.repartition("doc").dropDuplicates(["doc", "block"])


def entity() -> Column:
    """What a span stands for, however it is written."""
    same = F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(digits(F.col("value")))
    return F.concat("kind", F.lit(":"), same)


def contexts(spans: DataFrame, signed: DataFrame) -> DataFrame:
    """spans and signed(doc, text) -> spans with `context`: lower-cased words around them, from the blocks they begin and end in and those beside."""
    by = Window.partitionBy("doc").orderBy("block")
    wide = blocks(signed.join(spans.select("doc").distinct(), "doc", "left_semi")).select(
        "doc", "block", F.concat(F.coalesce(F.lag("part").over(by), F.lit("")), "part", F.coalesce(F.lead("part").over(by), F.lit(""))).alias("wide"))
    wide = keep(wide, "pii-blocks")
    first = F.greatest(F.col("block") - 1, F.lit(0)) * BLOCK
    at = spans.withColumn("block", F.floor(F.col("start") / BLOCK)).join(wide, ["doc", "block"])
    place = F.col("start") - first
    left = F.substring("wide", F.greatest(place + 1 - CONTEXT_CHARS, F.lit(1)).cast("int"), F.least(place, F.lit(CONTEXT_CHARS)).cast("int"))
    # Where the text goes on, the outermost word may be a part of one.
    left = F.when(F.col("start") > CONTEXT_CHARS, F.regexp_replace(left, r"^\S*\s?", "")).otherwise(left)
    at = at.select(*spans.columns, left.alias("left"), F.floor((F.col("end") - 1) / BLOCK).alias("block")).join(wide, ["doc", "block"])
    place = F.col("end") - first
    right = F.substring("wide", (place + 1).cast("int"), F.lit(CONTEXT_CHARS))
    right = F.when(F.char_length("wide") > place + CONTEXT_CHARS, F.regexp_replace(right, r"\s?\S*$", "")).otherwise(right)
    words = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    near = F.concat(F.slice(F.reverse(words(F.col("left"))), 1, CONTEXT_WORDS), F.slice(words(right), 1, CONTEXT_WORDS))
    return at.select(*spans.columns, F.lower(F.array_join(near, " ")).alias("context"))


def terms_of(docs: DataFrame) -> DataFrame:
    """(doc, term) of docs(doc, text): each term of a document once."""
    return docs.select("doc", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def disclosures(near: DataFrame, held: DataFrame, docs: DataFrame, min_texts: int, remove: float, generalise: float) -> DataFrame:
    """(entity, term, action) of the terms that reveal an entity, in shares of its information content; near(doc, copy, entity, context), held(doc, text): documents with spans, docs: all."""
    terms = near.select("doc", "copy", "entity", F.xxhash64("context").alias("c"), F.explode(F.array_distinct(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)))).alias("term"))
    by_doc = terms.groupBy("entity", "term", "doc", "copy").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    pairs = by_doc.groupBy("entity", "term").agg(
        F.count("*").alias("n_tc"), (F.min("low") < F.max("high")).alias("contexts"), (F.min("copy") < F.max("copy")).alias("texts"))
    # Two contexts and two texts: some two places then differ in both.
    pairs = pairs.select("entity", "term", "n_tc", (F.col("contexts") & F.col("texts")).alias("twice"))
    pairs = pairs.filter("twice") if min_texts > 1 else pairs
    n_c = near.select("entity", "doc").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    n = docs.agg(F.count_distinct("doc").alias("n"))
    pairs = pairs.join(n_c, "entity").join(F.broadcast(n), how="cross")  # n is one row
    content = F.log(F.col("n") / F.col("n_c"))
    # A term in more of the documents with entities than this can't reveal that one, whatever the rest of the corpus holds.
    most = F.col("n_tc") / F.exp((F.when(F.col("twice"), min(generalise, remove)).otherwise(remove) - 1) * content) + 1e-6
    often = terms_of(held).groupBy("term").agg(F.count("*").alias("seen"))
    pairs = keep(pairs.filter(F.col("n_c") < F.col("n")).join(often, "term").filter(F.col("seen") <= most).drop("seen"), "pii-pairs")
    candidates = small(pairs.select("term").distinct(), SMALL_TERMS)
    n_t = terms_of(docs).join(candidates, "term").groupBy("term").agg(F.count_distinct("doc").alias("n_t"))
    joined = pairs.join(n_t, "term")
    pmi = F.log(F.col("n_tc") / F.col("n_t") * F.col("n") / F.col("n_c"))
    action = F.when(pmi >= remove * content - 1e-9, "remove").when((pmi >= generalise * content) & F.col("twice"), "generalise")
    return joined.select("entity", "term", action.alias("action")).filter("action is not null")


def find_personal_data(docs: DataFrame, min_texts: int = 2, everywhere: bool = False, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, doc, text (if it has spans), a column of spans for each kind, and `terms`: array of (start, end, value, action)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.struct("doc_id", F.xxhash64(text).alias("hash")).alias("doc"))
    can = signs(F.col("text"))
    signed = keep(keyed.filter(can["email"] | can["ip"] | can["card"] | can["phone"]).select("doc", "text"), "pii-signed")
    spans = keep(base_spans(signed), "pii-spans")
    copies = signed.select("doc", F.xxhash64(F.lower("text")).alias("copy")).dropDuplicates(["doc"])
    near = contexts(spans.withColumn("entity", entity()), signed).join(copies, "doc").select("doc", "copy", "entity", "context")
    held = signed.join(spans.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    told = keep(disclosures(keep(near, "pii-near"), held, keyed, min_texts, remove, generalise), "pii-told")
    if everywhere:
        told = told.groupBy("term").agg(F.max("action").alias("action"))  # removing goes before generalising
        revealing = terms_of(keyed).join(small(told, SMALL_TERMS), "term")
    else:
        of = spans.select("doc", entity().alias("entity")).distinct()
        revealing = of.join(small(told, SMALL_TERMS), "entity")
    # A term that reveals several entities of a document is removed if one of them asks for it.
    revealing = keep(revealing.groupBy("doc", "term").agg(F.max("action").alias("action")), "pii-revealing")
    texts = keyed.select("doc", "text").join(small(revealing.select("doc").distinct(), SMALL_TERMS), "doc")
    form = F.lit(r"(?<![\p{L}\p{N}'-])" + TERM)
    words = located(texts.select("doc", F.explode(matches(F.col("text"), form, "term")).alias("x")).select("doc", "x.*"))
    terms = words.withColumn("term", F.lower("value")).join(revealing, ["doc", "term"]).drop("term")
    every = spans.withColumn("action", F.lit(None).cast("string")).unionByName(terms)
    every = keep(apart(every), "pii-all")
    parts = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end", "value")))) for k in KINDS}
    parts["terms"] = F.array_sort(F.collect_list(F.when(F.col("kind") == "term", F.struct("start", "end", "value", "action"))))
    found = every.groupBy(F.col("doc").alias("of")).agg(*[c.alias(k) for k, c in parts.items()])
    out = keyed.join(small(found, SMALL_TERMS), F.col("doc").eqNullSafe(F.col("of")), "left")
    none = "array<struct<start:bigint,end:bigint,value:string"
    filled = [F.coalesce(k, F.array().cast(f"{none}{',action:string' if k == 'terms' else ''}>>")).alias(k) for k in parts]
    return out.select("doc_id", "doc", F.when(F.col("of").isNotNull(), F.col("text")).alias("text"), *filled)


def apart(spans: DataFrame) -> DataFrame:
    """Spans without the terms that overlap a span of another kind."""
    base = F.col("kind") != "term"
    forward = Window.partitionBy("doc").orderBy("start", base.desc()).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("doc").orderBy(F.col("start").desc(), base.desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = spans.withColumn("_before", F.max(F.when(base, F.col("end"))).over(forward)).withColumn("_after", F.min(F.when(base, F.col("start"))).over(back))
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.col("_after").isNull() | (F.col("_after") >= F.col("end")))
    return met.filter(base | free).drop("_before", "_after")


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and `clean`: base spans become [kind], terms go or become their sort of word. Texts without spans, of either sort, are null: they stay as they are."""
    mark = lambda k: lambda s: F.struct(s["start"], s["end"], F.lit(f"[{k}]").alias("by"))
    sort = lambda v: F.when(v.rlike("^[0-9]+$"), "[number]").when(v.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")
    of_term = lambda s: F.struct(s["start"], s["end"], F.when(s["action"] == "remove", "").otherwise(sort(s["value"])).alias("by"))
    every = F.concat(*[F.transform(k, mark(k)) for k in KINDS], F.transform("terms", of_term))
    marks = found.dropDuplicates(["doc"]).select("doc", F.explode(every).alias("x")).select("doc", "x.*")
    # Spans of two kinds may overlap: what hangs together becomes what its first one does.
    order = Window.partitionBy("doc").orderBy("start", "end", "by")
    begins = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    groups = marks.withColumn("_new", begins.cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("doc", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "by")).alias("first"))
    spread = whole.select("doc", "start", "end", F.col("first.by").alias("by"), F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    base = F.col("block") * BLOCK
    cut = spread.select("doc", "block", F.struct(
        F.greatest(F.col("start") - base, F.lit(0)).alias("start"), F.least(F.col("end") - base, F.lit(BLOCK)).alias("end"),
        F.when(F.col("start") >= base, F.col("by")).otherwise("").alias("by")).alias("mark")).groupBy("doc", "block").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    joined = blocks(found.filter("text is not null").select("doc", "text")).join(cut, ["doc", "block"], "left")
    step = lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring("part", (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int")), m["by"]).alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring("part", (acc["at"] + 1).cast("int"), F.lit(BLOCK)))
    clean = F.when(F.col("marks").isNull(), F.col("part")).otherwise(F.aggregate("marks", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, rest))
    texts = joined.groupBy(F.col("doc").alias("of")).agg(F.array_sort(F.collect_list(F.struct("block", clean.alias("clean")))).alias("parts"))
    texts = texts.select("of", F.array_join(F.transform("parts", lambda p: p["clean"]), "").alias("clean"))
    return found.select("doc_id", "doc").join(texts, F.col("doc").eqNullSafe(F.col("of")), "left").select("doc_id", "clean")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that disclose it wherever they stand; null texts are empty."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), min_texts=1, everywhere=True)
    say = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"])
    said = {k: F.transform(k, say(k)) for k in KINDS}
    terms = F.transform("terms", say("term"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*said.values()), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*said.values(), terms), ",").alias("spans"))
