"""Operator 11: phrases whose words stand together more often than they would by chance.

Texts are cut into pieces and words, and each word begins a suffix: it and the words that follow in its
piece, MOST at most. Suffixes are routed by their leading words, so that all that begin alike meet, and
are sorted there by multikey three-way quicksort: a part of suffixes is split by the word at one depth
into those below, equal to and above a pivot. The equal part is a phrase, its size is how often the
phrase occurs, and it goes on one word deeper; a part smaller than the least count is abandoned.

Before that, words and pairs of words are counted by buckets of their hashes, and then triples whose
pairs may be frequent, and the words of such pairs. A bucket below the least count holds nothing frequent:
suffixes end before such a pair or triple, and words that stand in no such pair begin none. The buckets
become bitmaps whose size follows the input up to BUCKETS; above it, more infrequent suffixes are sorted,
with the same result. Suffixes that are equal are sent once by a task, with their number, as far as it
remembers them, and all that a task has for a range of routes is one row.

Leading words with more than 1/HOT of everything are told by the same counts, HOT of them at most: their
suffixes are routed by two leading words, and those of a hot pair by all their words. What such a word or
pair counts is then spread, isn't abandoned, and is added up at the end, as are counts of suffixes that
are more than a sorted block takes.

Candidates are joined with the counts of their parts; numbers are decimals of 38 digits.

Defined cases: a null or empty text has no words; a null lang is `und`; repeated rows count each;
columns other than text and lang are left alone; an empty table gives no rows. Words are what they are
in bytes, lower-cased in A-Z only; a hash decides only what is equal within a batch, by 64 bits of random
polynomials.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Words of a phrase; occurrences of a candidate; phrases of a language that are returned.
MOST, LEAST, TOP = 5, 100, 2000
#: Buckets at most (their bitmap has as many bits); bytes of text for a bucket; leading words that count as hot.
BUCKETS, BYTES_OF_A_BUCKET, HOT = 1 << 28, 64, 1024
#: Bytes of text handled at once; hashes counted at once; suffixes that a task remembers; suffixes of a sorted block.
AT_ONCE, COUNTED, REMEMBERED, BLOCK = 1 << 21, 4_000_000, 1_000_000, 300_000
#: Buckets of a range, which is counted in one place; bytes of text for a range of routes.
RANGE, BYTES_OF_A_RANGE = 1 << 16, 1 << 22
#: What is known of a suffix.
FIELDS = ["lang", "suffix", "n", "whole", "route"]
#: Kinds of bytes: of words, between words, between pieces.
WORD, GAP, END = 0, 1, 2
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
_draw = np.random.default_rng(11)
#: A random number for each byte, the same for both cases of a letter; base of the polynomial, and its inverse modulo 2^64.
LETTER = _draw.integers(0, 1 << 63, 256, dtype=np.uint64)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, AT_ONCE), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt) if isinstance(salt, int) else h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: where they begin and end in the bytes, the text and a hash of each, whether the next is in the same piece."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        """langs: of each text; hashes of words differ by them."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.data = data.tobytes().lower()  # bytes: A-Z only
        at = offsets - offsets[0]
        kind = KIND[data]
        inner = kind == WORD
        first = np.zeros(len(data) + 1, dtype=bool)
        first[at] = True  # nothing goes on into the next text
        before = np.concatenate([[False], inner[:-1]]) if len(data) else inner
        self.begin = np.flatnonzero(inner & (~before | first[:-1]))
        self.end = np.flatnonzero(inner & (~np.append(inner[1:], False) | first[1:])) + 1
        self.text = np.searchsorted(at, self.begin, "right") - 1
        ends = np.cumsum(kind == END, dtype=np.int32)[self.begin] if len(data) else self.begin
        self.joined = np.append((ends[1:] == ends[:-1]) & (self.text[1:] == self.text[:-1]), False) if len(self.begin) else np.empty(0, dtype=bool)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(LETTER[data] * powers(BASE, len(data)), dtype=np.uint64)])
        h = (sums[self.end] - sums[self.begin]) * powers(INVERSE, len(data) + 1)[self.begin]
        names, self.lang = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.empty(0), np.empty(0, dtype=int))
        self.langs = names.tolist()
        salt = np.array([int.from_bytes(_digest(x), "little") for x in self.langs], dtype=np.uint64)
        self.hash = mixed(h, salt[self.lang[self.text]]) if len(h) else h

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words of pairs, hashes of pairs)."""
        one = np.flatnonzero(self.joined)
        return one, mixed(self.hash[one] * np.uint64(3) + self.hash[one + 1], 1)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def texts_of(part: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch, some texts at a time."""
    texts = part.column("text").cast(pa.large_string())
    langs = part.column("lang").to_pylist()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
        yield Words(texts.slice(a, b - a), langs[a:b])
        a = b


class Bits:
    """A bit for each of some buckets, a power of two."""

    def __init__(self, buckets: int, parts: list[tuple[int, bytes]] = ()):
        self.mask, self.bits = np.uint64(buckets - 1), np.zeros(max(1, buckets >> 3), dtype=np.uint8)
        for k, part in parts:
            self.bits[k * (RANGE >> 3) :][: len(part)] = np.frombuffer(part, dtype=np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h & self.mask).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def packed(keys: np.ndarray) -> pa.RecordBatch:
    """Buckets with their counts, a row for each range."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    bucket, n = keys[starts].astype(np.int64), np.diff(np.append(starts, len(keys))).astype("<u4")
    of = bucket // RANGE
    ranges, first = np.unique(of, return_index=True)
    cuts = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)])]
    at = (bucket % RANGE).astype("<u2")
    return pa.RecordBatch.from_arrays([pa.array([None] * len(ranges), pa.string()), pa.array(ranges, pa.int64()), pa.array([at[c].tobytes() for c in cuts], pa.binary()), pa.array([n[c].tobytes() for c in cuts], pa.binary()), pa.array([None] * len(ranges), pa.int64())], ["lang", "range", "at", "n", "total"])


def counted(docs: DataFrame, buckets: int, least: int, hashes, name: str) -> DataFrame:
    """docs(text, lang) -> (lang, total): all words; and for ranges of buckets (range, bits: which of them count `least` or more, total, most: (bucket, n) of the fullest).

    hashes gives what is counted of some words.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, words_of = [], 0, Counter()
        for part in parts:
            for words in texts_of(part):
                if not len(words.hash):
                    continue
                keys = (hashes(words) & np.uint64(buckets - 1)).astype(np.uint32)
                waiting.append(keys)
                size += len(keys)
                words_of.update(dict(zip(words.langs, np.bincount(words.lang[words.text], minlength=len(words.langs)).tolist())))
                if size > COUNTED:
                    yield packed(np.concatenate(waiting))
                    waiting, size = [], 0
        if waiting:
            yield packed(np.concatenate(waiting))
        none = [None] * len(words_of)
        yield pa.RecordBatch.from_arrays([pa.array(list(words_of), pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(list(words_of.values()), pa.int64())], ["lang", "range", "at", "n", "total"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range."""
        now, sums, totals = None, np.zeros(RANGE, dtype=np.int64), Counter()
        for part in parts:
            for lang, k, at, n, total in zip(*(part.column(c).to_pylist() for c in ("lang", "range", "at", "n", "total"))):
                if k is None:
                    totals[lang] += total
                    continue
                if k != now:
                    if now is not None:
                        yield ended(now, sums)
                    now, sums = k, np.zeros(RANGE, dtype=np.int64)
                sums[np.frombuffer(at, dtype="<u2")] += np.frombuffer(n, dtype="<u4")
        if now is not None:
            yield ended(now, sums)
        if totals:
            none = [None] * len(totals)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(list(totals.values()), pa.int64()), pa.array(none, most)], ["lang", "range", "bits", "total", "most"])

    most = pa.list_(pa.struct([("bucket", pa.int64()), ("n", pa.int64())]))

    def ended(k: int, sums: np.ndarray) -> pa.RecordBatch:
        top = np.argsort(-sums, kind="stable")[:HOT]
        full = [{"bucket": k * RANGE + int(b), "n": int(sums[b])} for b in top if sums[b] >= least]
        bits = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([k], pa.int64()), pa.array([bits], pa.binary()), pa.array([int(sums.sum())], pa.int64()), pa.array([full], most)], ["lang", "range", "bits", "total", "most"])

    rows = docs.mapInArrow(count, "lang string, range long, at binary, n binary, total long")
    by = F.coalesce("range", F.xxhash64("lang"))
    return keep(rows.repartition(by).sortWithinPartitions("range").mapInArrow(add, "lang string, range long, bits binary, total long, most array<struct<bucket:long,n:long>>"), name)


def bits_of(counts: DataFrame, buckets: int) -> Bits:
    """A bit for each bucket; BUCKETS of them at most come to the driver, whatever the input."""
    return Bits(buckets, [(r["range"], r["bits"]) for r in counts.filter("lang is null").select("range", "bits").toLocalIterator()])


def frequent(docs: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """docs(text, lang) -> (lang, phrase, f) of all phrases and words with f >= least, and (lang, total)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(BUCKETS, 1 << max(16, int(size // BYTES_OF_A_BUCKET).bit_length()))
    counts = counted(docs, buckets, least, lambda words: np.concatenate([words.hash, words.pairs()[1]]), "one-and-two")
    totals = counts.filter("lang is not null").groupBy("lang").agg(F.sum("total").alias("total"))
    of_pairs = spark.sparkContext.broadcast(bits_of(counts, buckets))
    everything = counts.filter("lang is null").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    # HOT of them at most, as each has more than 1 / HOT of everything.
    hot = counts.select(F.explode("most").alias("x")).filter(F.col("x.n") * HOT > everything).select("x.bucket").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot], dtype=np.int64)))

    def triples(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of triples whose pairs may be frequent."""
        one, pair = words.pairs()
        goes_on = np.zeros(len(words.hash) + 1, dtype=bool)
        goes_on[one] = of_pairs.value(pair)
        first = np.flatnonzero(goes_on[:-1] & goes_on[1:])
        return first, mixed(words.hash[first] * np.uint64(7) + words.hash[first + 1] * np.uint64(3) + words.hash[first + 2], 2)

    def in_pairs(words: Words) -> np.ndarray:
        """Hashes of the words of pairs that may be frequent; a frequent pair's words come as often as it."""
        one, pair = words.pairs()
        one = one[of_pairs.value(pair)]
        return mixed(words.hash[np.concatenate([one, one + 1])], 9)

    counts = counted(docs, buckets, least, lambda words: np.concatenate([triples(words)[1], in_pairs(words)]), "three")
    of_triples = spark.sparkContext.broadcast(bits_of(counts, buckets))
    shift = np.uint64(64 - max(12, int(size // BYTES_OF_A_RANGE).bit_length()))

    def suffixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = lambda h: np.isin((h & np.uint64(buckets - 1)).astype(np.int64), hot.value)
        known, sums, told = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), []
        new: list[tuple] = []
        for part in parts:
            for words in texts_of(part):
                n = len(words.hash)
                if not n:
                    continue
                one, pair = words.pairs()
                first = np.flatnonzero(of_triples.value(mixed(words.hash, 9)))
                goes_on, again = np.zeros(n + most, dtype=bool), np.zeros(n + most, dtype=bool)
                goes_on[one] = of_pairs.value(pair)
                begin, three = triples(words)
                again[begin] = of_triples.value(three)
                length, same = np.ones(len(first), dtype=np.int64), np.ones(len(first), dtype=bool)
                key = words.hash[first]
                for d in range(1, most):
                    same = same & (goes_on[first] if d == 1 else again[first + d - 2])
                    length += same
                    key = np.where(same, mixed(key * np.uint64(5) + words.hash[np.minimum(first + d, n - 1)], d), key)
                uniq, at, count = np.unique(key, return_index=True, return_counts=True)
                if len(known):
                    place = np.minimum(np.searchsorted(known, uniq), len(known) - 1)
                    there = known[place] == uniq
                    sums[place[there]] += count[there]
                    uniq, at, count = uniq[~there], at[~there], count[~there]
                of_pair = np.zeros(n, dtype=np.uint64)
                of_pair[one] = pair
                begin, m = first[at], length[at]
                whole = np.where(within(words.hash[begin]), np.where((m > 1) & within(of_pair[begin]), most, 2), 1)
                route = np.where(whole == 1, words.hash[begin], np.where((whole == 2) & (m > 1), of_pair[begin], uniq))
                names = np.array(words.langs, dtype=object)[words.lang[words.text[begin]]]
                text = [b" ".join(words.data[a:b].split()) for a, b in zip(words.begin[begin].tolist(), words.end[begin + m - 1].tolist())]
                new.append((uniq, count, names, np.array(text, dtype=object), whole, route))
                if sum(len(x[0]) for x in new) > REMEMBERED // 4:
                    known, sums, told = together(known, sums, told, new)
                    new = []
                    if len(known) > REMEMBERED:
                        yield from sent(sums, told)
                        known, sums, told = known[:0], sums[:0], []
        known, sums, told = together(known, sums, told, new)
        yield from sent(sums, told)

    def together(known: np.ndarray, sums: np.ndarray, told: list, new: list[tuple]) -> tuple[np.ndarray, np.ndarray, list]:
        """Sorted keys, their sums and what belongs to them, with new ones among them."""
        if not new:
            return known, sums, told
        key, n = np.concatenate([known, *(x[0] for x in new)]), np.concatenate([sums, *(x[1] for x in new)])
        rest = [np.concatenate([*([told[c - 2]] if told else []), *(x[c] for x in new)]) for c in range(2, 6)]
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        out = np.zeros(len(key), dtype=np.int64)
        np.add.at(out, back, n)
        return key, out, [r[at] for r in rest]

    def sent(sums: np.ndarray, told: list) -> Iterator[pa.RecordBatch]:
        """A row for each range of routes."""
        if not len(sums):
            return
        lang, text, whole, route = told
        by = np.argsort(route, kind="stable")
        ranges = (route[by] >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]]))
        rows = pa.StructArray.from_arrays([
            pa.array(lang[by], pa.string()), pa.array(text[by], pa.binary()).cast(pa.string()), pa.array(sums[by], pa.int64()), pa.array(whole[by], pa.int64()), pa.array(route[by].astype(np.int64), pa.int64())], FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)], ["range", "rows"])

    def mine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range; a block ends where a range does, unless a range is more than a block."""
        rest, cut = None, None
        for part in parts:
            lists = part.column("rows")
            now = pa.Table.from_arrays([*lists.flatten().flatten(), pa.array(np.repeat(part.column("range").to_numpy(), np.diff(lists.offsets.to_numpy())))], [*FIELDS, "range"])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if rest.num_rows < BLOCK:
                continue
            of = rest.column("range").to_numpy()
            ends = np.flatnonzero(of != of[-1])
            end = int(ends[-1]) + 1 if len(ends) else len(of)
            yield from blocks(rest.slice(0, end).combine_chunks(), {cut} if len(ends) else {cut, int(of[-1])})
            cut = cut if len(ends) == 0 and cut == int(of[-1]) else None if len(ends) else int(of[-1])
            rest = rest.slice(end)
        if rest is not None and rest.num_rows:
            yield from blocks(rest.combine_chunks(), {cut})

    def blocks(rows: pa.Table, parted: set) -> Iterator[pa.RecordBatch]:
        """Sorts rows of one lang and whole at a time; of ranges that are parted nothing is abandoned."""
        whole, lang = rows.column("whole").to_numpy().astype(np.int64), rows.column("lang").to_numpy().astype(str)
        whole[np.isin(rows.column("range").to_numpy(), [x for x in parted if x is not None])] = most + 1
        for w in np.unique(whole).tolist():
            for name in np.unique(lang[whole == w]).tolist():
                some = rows.filter(pa.array((whole == w) & (lang == name)))
                found = quicksorted(some.column("suffix"), some.column("n").to_numpy(), w, least)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "phrase", "n"])

    sent_rows = docs.mapInArrow(suffixes, "range long, rows array<struct<lang:string,suffix:string,n:long,whole:long,route:long>>")
    routed = sent_rows.repartition("range").sortWithinPartitions("range")
    found = routed.mapInArrow(mine, "lang string, phrase string, n long")
    return keep(found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "frequent"), totals


def quicksorted(suffixes: pa.ChunkedArray, weights: np.ndarray, whole: int, least: int) -> list[tuple[str, int]]:
    """(phrase, n) of all beginnings of suffixes, by multikey three-way quicksort of pointers to them; those of `whole` words or more that occur less often than `least` are abandoned."""
    lists = pc.split_pattern(suffixes.combine_chunks() if isinstance(suffixes, pa.ChunkedArray) else suffixes, " ")
    coded = lists.flatten().dictionary_encode()
    names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    size = np.diff(lists.offsets.to_numpy())
    depth = int(size.max())
    words = np.full((len(size), depth + 1), -1, dtype=np.int64)
    words[np.repeat(np.arange(len(size)), size), np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)] = ids
    pointers, out = np.arange(len(size)), []
    todo = [(0, len(size), 0)]
    while todo:
        lo, hi, d = todo.pop()
        own = pointers[lo:hi]
        if d + 1 >= whole and weights[own].sum() < least:
            continue
        at = words[own, d]
        a, b, c = at[0], at[len(at) // 2], at[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        low, high = own[at < pivot], own[at > pivot]
        same = own[at == pivot]
        pointers[lo : lo + len(low)], pointers[lo + len(low) : hi - len(high)], pointers[hi - len(high) : hi] = low, same, high
        if len(low):
            todo.append((lo, lo + len(low), d))
        if len(high):
            todo.append((hi - len(high), hi, d))
        if pivot >= 0:
            n = int(weights[same].sum())
            if n >= least or d + 1 < whole:
                out.append((" ".join(names[w] for w in words[same[0], : d + 1]), n))
                if d + 1 < depth:
                    todo.append((lo + len(low), hi - len(high), d + 1))
    return out


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    pieces = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counts, totals = frequent(pieces, least, most)
    words = F.split("phrase", " ")
    phrases = counts.select("lang", words.alias("w"), F.col("f").alias("a")).filter(F.size("w") > 1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    known = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = known.withColumn("score", F.expr("(1000bd * cast(a as decimal(15,0)) * cast(total as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    best = scored.groupBy("lang", "w", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "w", "a", F.col("total").alias("n"), "x.*")
    # Inner phrases of a candidate that occur no more often than it.
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.slice("w", i, m)))))
    around = phrases.filter(F.size("w") > 2).select("lang", inner.alias("w"), "a").groupBy("lang", "w").agg(F.max("a").alias("longer"))
    left = best.join(around, ["lang", "w"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100)).withColumn("phrase", F.array_join("w", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    return left.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents, by score."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
sentences AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM sentences WHERE len(ws) > 0),
grams AS (SELECT lang, ws[i:i + m - 1] AS w FROM places, (SELECT unnest(range(1, 6)) AS m) AS sizes WHERE i + m - 1 <= len(ws)),
counts AS (SELECT lang, w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY ALL),
cuts AS (SELECT c.lang, c.w, c.f AS a, unnest(range(1, len(c.w))) AS k FROM counts AS c WHERE len(c.w) > 1),
scored AS (
  SELECT c.lang, c.w, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.w = c.w[1:c.k] JOIN counts AS y ON y.lang = c.lang AND y.w = c.w[c.k + 1:len(c.w)] JOIN totals AS t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (
  SELECT lang, w[i:i + m - 1] AS w, max(f) AS longer
  FROM (SELECT lang, w, f, m, unnest(range(1, len(w) - m + 2)) AS i FROM counts, (SELECT unnest(range(2, 5)) AS m) AS sizes WHERE len(w) > m) AS x GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.w = b.w WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
