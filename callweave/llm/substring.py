"""Operator 9: substring dedup by repeated-phrase automata.

A window is so many consecutive words. Each window has a fingerprint, the smallest hash of the phrases
in it, so that equal windows have the same one. Phrases that recur are found by counting fingerprints;
documents then send the passages whose fingerprint recurs to its shard. A shard confirms the recurring
windows of its passages, compiles an Aho-Corasick automaton from them and streams all its passages, in
order of documents, through it: every occurrence but a window's first is covered. Covered words go.

Phrases that very many documents hold are thinned out before they are shuffled. Of a fingerprint that
a batch holds in several texts only two go to where it is counted; the others are known to recur. A
passage that a task has sent once is covered wherever it stands again later, and isn't sent again.

Equal texts are one document here: the first is searched, later ones lose all if they have a window.
Word sequences are compared as sequences of 64-bit word hashes.

Defined cases: a null text has no words; a document shorter than a window loses nothing; null ids come
before all others; texts of one id are ordered by their hash, and rows that repeat id and text are one
document, returned each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, table

WINDOW, PHRASE = 20, 8
#: Words and passages that a task remembers; windows of a passage; passages of an automaton.
REMEMBERED, SENT, LONGEST, PASSAGES = 1_000_000, 500_000, 256, 20_000
#: What is known of a fingerprint in a text: it stands there once, stands there again, or recurs elsewhere.
ONCE, AGAIN, SETTLED = 0, 1, 2
RANGES = "array<struct<start:int,n:int>>"


def word_hashes(text: str | None, known: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: at ASCII white space only
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return words, np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive numbers."""
    g = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for i in range(k):
        g = (g ^ h[i : len(g) + i]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g


def passages(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first window, number of windows) of the runs of windows with the same fingerprint."""
    g = mixed(h, PHRASE)
    if len(h) < WINDOW:
        return g[:0], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    low, span, width = g, 1, WINDOW - PHRASE + 1  # smallest of `width` phrases, by doubling
    while span < width:
        step = min(span, width - span)
        low, span = np.minimum(low[:-step], low[step:]), span + step
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[starts], starts, np.diff(np.append(starts, len(low)))


def recurring(docs: DataFrame) -> DataFrame:
    """docs(hash, text) -> (hash, prints): fingerprints of a text that recur, in another text or itself."""

    def prints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = {}, set()
        for part in parts:
            out, of, again = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int8)]
            for h, text in zip(part.column("hash").to_pylist(), part.column("text").to_pylist()):
                if h in seen:
                    continue
                seen.add(h)
                hashes = word_hashes(text, known)[1]
                found = np.unique(passages(hashes)[0])
                if len(found):
                    every = np.sort(mixed(hashes, PHRASE))
                    out.append(found)
                    of.append(np.full(len(found), h, dtype=np.int64))
                    # A window that recurs in its own text has a phrase that stands there twice.
                    twice = np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left") > 1
                    again.append(np.where(twice, AGAIN, ONCE).astype(np.int8))
            p, known_as = np.concatenate(out), np.concatenate(again)
            order = np.argsort(p, kind="stable")  # rows of one print are of different texts
            third = np.flatnonzero(p[order][2:] == p[order][:-2]) + 2
            known_as[order[third]] = SETTLED
            yield pa.RecordBatch.from_pydict({"print": p.astype(np.int64), "hash": np.concatenate(of), "again": known_as})

    def repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by print and hash; a row whose print isn't known to recur yet waits for the next."""
        last, wait = None, None
        for part in parts:
            p, h, again = (part.column(c).to_numpy(zero_copy_only=False) for c in ("print", "hash", "again"))
            settled = again == SETTLED
            if settled.any():
                yield rows(p[settled], h[settled])
                p, h, again = p[~settled], h[~settled], again[~settled]
            if not len(p):
                continue
            again = again == AGAIN
            same = np.concatenate([[last is not None and p[0] == last[0]], p[1:] == p[:-1]])
            other = np.concatenate([[bool(same[0]) and h[0] != last[1]], same[1:] & (h[1:] != h[:-1])])
            starts = np.flatnonzero(np.concatenate([[True], ~same[1:]]))
            yes = np.logical_or.reduceat(other | again, starts)
            yes[0] |= bool(same[0]) and last[2]
            take = np.repeat(yes, np.diff(np.append(starts, len(p)))) & (~same | other)  # a print and hash once
            if wait is not None and same[0] and yes[0]:
                yield rows([wait[0]], [wait[1]])
            if yes[-1]:
                wait = None
            elif len(starts) > 1 or not same[0]:
                wait = (p[-1], h[-1])
            last = (p[-1], h[-1], bool(yes[-1]))
            yield rows(p[take], h[take])

    def rows(p, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"print": pa.array(p, pa.int64()), "hash": pa.array(h, pa.int64())})

    counted = docs.mapInArrow(prints, "print long, hash long, again byte")
    counted = counted.repartition(F.when(F.col("again") == SETTLED, F.col("hash")).otherwise(F.col("print"))).sortWithinPartitions("print", "hash")
    found = counted.mapInArrow(repeated, "print long, hash long")
    return keep(found.groupBy("hash").agg(F.collect_set("print").alias("prints")), "recurring")


def covered(docs: DataFrame) -> DataFrame:
    """docs(id, hash, text, prints) -> (id, hash, ranges): runs of windows (start, n) that occur earlier."""
    places, kinds = ["print", "id", "hash", "start", "words", "n"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents come in order of id and hash; a passage that went before is a covered range (n), without words."""
        known, before = {}, set()
        for part in parts:
            out = []
            for i, h, text, prints in zip(*(part.column(c).to_pylist() for c in ("id", "hash", "text", "prints"))):
                hashes = word_hashes(text, known)[1]
                found, starts, n = passages(hashes)
                ours = np.isin(found.astype(np.int64), np.array(prints, dtype=np.int64))
                for p, a, k in zip(found[ours].astype(np.int64), starts[ours], n[ours]):
                    for b in range(a, a + k, LONGEST):
                        m = min(LONGEST, a + k - b)
                        words = hashes[b : b + m + WINDOW - 1].tobytes()
                        key = xxhash.xxh3_128_digest(words)
                        if key in before:
                            out.append((h, i, h, b, None, m))
                            continue
                        if len(before) >= SENT:
                            before.clear()
                        before.add(key)
                        out.append((p, i, h, b, words, None))
                if len(out) > 20_000:
                    yield sent(out)
                    out = []
            yield sent(out)

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], places)

    def shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, earlier = None, (None, set())
        for part in parts:
            told = part.column("n").is_valid()
            if part.num_rows > told.false_count:
                yield part.filter(told).select(["id", "hash", "start", "n"])
                part = part.filter(pc.invert(told))
            now = pa.Table.from_batches([part] if rest is None else [rest, part]).combine_chunks()
            rest = None
            if now.num_rows < PASSAGES:
                rest = now.to_batches()[0] if now.num_rows else None
                continue
            p = now.column("print").to_numpy()
            end = int(np.flatnonzero(p != p[-1])[-1]) + 1 if p[0] != p[-1] else now.num_rows
            ready = now.slice(0, end)
            rest = now.slice(end).combine_chunks().to_batches()[0] if end < now.num_rows else None
            out, earlier = locate(ready, earlier)
            yield out
        if rest is not None:
            yield locate(pa.Table.from_batches([rest]), earlier)[0]

    def locate(rows: pa.Table, earlier: tuple[int | None, set]) -> tuple[pa.RecordBatch, tuple[int | None, set]]:
        """Covered ranges of passages in order; earlier: a fingerprint whose passages went before, and its windows."""
        prints, ids, hashes, starts = (rows.column(c).to_numpy() for c in ("print", "id", "hash", "start"))
        words = [np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in rows.column("words")]
        size = np.array([len(w) for w in words])
        flat = np.concatenate(words)
        first = np.cumsum(size) - size
        window = mixed(flat, WINDOW)
        at = np.concatenate([np.arange(f, f + n - WINDOW + 1) for f, n in zip(first, size)])
        of = np.repeat(np.arange(len(size)), size - WINDOW + 1)
        value, begin, back, count = np.unique(window[at], return_index=True, return_inverse=True, return_counts=True)
        known = np.array([int(v) in earlier[1] for v in value]) if earlier[1] else np.zeros(len(value), dtype=bool)
        recurs = (count > 1) | known
        letter = np.unique(flat, return_inverse=True)[1]  # an automaton's letters are 32-bit numbers: those of its words
        phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k in np.flatnonzero(recurs):
            phrases.add_word(tuple(letter[at[begin[k]] : at[begin[k]] + WINDOW].tolist()), int(k))
        out = []
        if len(phrases):
            phrases.make_automaton()
            seen = set(np.flatnonzero(known).tolist())
            for s in np.unique(of[recurs[back]]):
                gone = []
                for end, k in phrases.iter(tuple(letter[first[s] : first[s] + size[s]].tolist())):
                    if k in seen:
                        gone.append(end - WINDOW + 1)
                    seen.add(k)
                if gone:
                    gone = np.array(gone)
                    edge = np.flatnonzero(np.concatenate([[True], np.diff(gone) > 1]))
                    for a, n in zip(gone[edge], np.diff(np.append(edge, len(gone)))):
                        out.append((ids[s], hashes[s], starts[s] + a, n))
        found = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(found)], ["id", "hash", "start", "n"])
        own = window[at[prints[of] == prints[-1]]].tolist()
        return batch, (prints[-1], ({*own} | earlier[1]) if earlier[0] == prints[-1] else {*own})

    ordered = docs.sortWithinPartitions("id", "hash")
    passed = ordered.mapInArrow(send, "print long, id long, hash long, start int, words binary, n int")
    in_order = passed.repartition("print").sortWithinPartitions("print", "id", "hash", "start")
    found = in_order.mapInArrow(shard, "id long, hash long, start int, n int")
    return keep(found.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "covered")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by a space), with a row for each document."""
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    first = keyed.groupBy("hash").agg(F.min("id").alias("first"))
    asked = recurring(keyed.select("hash", "text")).join(first, "hash").select(F.col("first").alias("id"), "hash", "prints")
    found = covered(keyed.select("id", "hash", "text").join(asked, ["id", "hash"]).dropDuplicates(["id", "hash"]))
    copies = keyed.select("id", "hash").distinct().join(first, "hash").filter("id > first").select("id", "hash", F.lit(True).alias("copy"))
    told = found.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("ranges", F.array().cast(RANGES)))

    def strip(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_words, n_removed, kept = [], [], []
            for text, copy, ranges in zip(*(part.column(c).to_pylist() for c in ("text", "copy", "ranges"))):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                if copy and len(words) >= WINDOW:
                    edge[0] += 1
                for r in ranges or ():
                    edge[r["start"]] += 1
                    edge[r["start"] + r["n"] - 1 + WINDOW] -= 1
                left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join([words[i] for i in left.tolist()]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(told, ["id", "hash"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "copy", "ranges")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document and those that go, as their window stands earlier; a null text has none."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*)::BIGINT AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
