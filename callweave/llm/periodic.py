"""Operator 12: runs of words that repeat with a period.

A run is a stretch of words with a smallest period, a given number of periods and words long at least,
that no neighbouring word extends. Words p apart that are the same for three periods hold three
multiples of p, wherever they begin: so each period is looked for on a grid of its own multiples only,
n / p points for p, and a point counts if words agree there and at the two points that follow. From such
a point the stretch is followed both ways by longest common extensions.

An extension is answered by a difference cover: only suffixes whose place is in the cover modulo V are
sorted, by words first and then by the ranks of the suffixes V, 2V, 4V ... further on, which are in the
cover too. Two places come to two covered ones after fewer than V words, which are compared, and the rest
is a minimum over the common prefixes of neighbours, from a sparse table. Backwards it is the same over
the reversed words. Documents of a batch share these arrays, a word of its own between any two of them;
only documents with a point that counts are sorted.

A document is handled whole in one task, as numbers of its words; no row depends on another one.

Defined cases: a null or empty text has no words and no runs; repeated rows and null ids are rows of
their own, and a text with a null id is never changed by `planted`; of runs with as many periods the
smallest start, then period, is the best; columns other than doc_id and text are left alone; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Side of the cover; V is its modulus.
SIDE = 8
V = SIDE * SIDE
#: Every difference modulo V is one of two members: a multiple of SIDE less one of 0 .. SIDE - 1.
IN_COVER = np.isin(np.arange(V), [*range(SIDE), *range(0, V, SIDE)])
#: By place modulo V and difference: words to the next two covered places.
AHEAD = np.array([[next(t for t in range(V) if IN_COVER[(a + t) % V] and IN_COVER[(a + d + t) % V]) for d in range(V)] for a in range(V)])
#: Words of documents that are handled together, unless one has more; extensions asked for together.
TOGETHER, ASKED = 400_000, 500_000
#: Periods that a run has at least, and words.
PERIODS, LONG = 4, 6
UNKNOWN = np.iinfo(np.int32).max
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RESULT = "array<struct<start:long,length:long,period:long>>"


class Minima:
    """Smallest values of ranges of an array, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest of lo .. hi, both included."""
        k = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), dtype=self.levels[0].dtype)
        for level in np.unique(k):
            of = k == level
            out[of] = np.minimum(self.levels[level][lo[of]], self.levels[level][hi[of] - (1 << int(level)) + 1])
        return out


class Extensions:
    """How many words agree from two places of one document on.

    words: numbers below 2^31; each document ends with a number that is nowhere else. doc: the document
    of each word, never falling.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.words = np.concatenate([words, np.zeros(V + 2, dtype=words.dtype)]).astype(np.int64)
        place = np.flatnonzero(IN_COVER[np.arange(len(words)) % V])
        self.sample = np.full(len(words), -1, dtype=np.int64)
        self.sample[place] = np.arange(len(place))
        begin = np.concatenate([[True], doc[place][1:] != doc[place][:-1]])
        self.order = np.arange(len(place))  # of samples; those that are not told apart yet stand together
        self.rank = np.maximum.accumulate(np.where(begin, self.order, 0))  # by sample: where its group begins
        self.common = np.where(begin, 0, UNKNOWN).astype(np.int32)  # by place in the order: words shared with the one before
        for t in range(0, V, 2):
            if not self.split(lambda s, t=t: (self.words[place[s] + t] << 31) | self.words[place[s] + t + 1],
                              lambda a, b, t=t: t + (self.words[place[a] + t] == self.words[place[b] + t])):
                break
        far = V
        while True:
            minima = Minima(self.common)
            old, at = self.rank.copy(), self.sample

            def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                x, y = old[at[place[a] + far]], old[at[place[b] + far]]
                return far + minima.between(np.minimum(x, y) + 1, np.maximum(x, y))

            if not self.split(lambda s: old[at[place[s] + far]], shared):
                break
            far *= 2
        self.minima = Minima(self.common)

    def split(self, key, shared) -> bool:
        """Tells members of groups apart by a key of samples; whether there were any groups left."""
        starts = np.flatnonzero(np.append(self.rank[self.order], len(self.order)) == np.arange(len(self.order) + 1))
        sizes = np.diff(starts)
        if not len(sizes) or sizes.max() < 2:
            return False
        group = np.repeat(starts[:-1], sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        s, group = self.order[tied], group[tied]
        k = key(s)
        by = np.lexsort((k, group))
        s, k = s[by], k[by]
        self.order[tied] = s
        begins = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[False], ~begins[1:] & (k[1:] != k[:-1])])
        self.rank[s] = tied[np.maximum.accumulate(np.where(begins | new, np.arange(len(tied)), 0))]
        cut = np.flatnonzero(new)
        self.common[tied[cut]] = shared(s[cut - 1], s[cut])
        return True

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), dtype=np.int64)
        for a in range(0, len(i), ASKED):
            out[a : a + ASKED] = self.some(i[a : a + ASKED], j[a : a + ASKED])
        return out

    def some(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ahead = AHEAD[i % V, (j - i) % V]
        out, left, t = ahead.copy(), np.arange(len(i)), 0
        synchronised = []
        while len(left):
            there = ahead[left] == t
            synchronised.append(left[there])
            left = left[~there]
            same = self.words[i[left] + t] == self.words[j[left] + t]
            out[left[~same]] = t
            left, t = left[same], t + 1
        come = np.concatenate(synchronised) if synchronised else left
        x, y = self.rank[self.sample[i[come] + ahead[come]]], self.rank[self.sample[j[come] + ahead[come]]]
        out[come] += self.minima.between(np.minimum(x, y) + 1, np.maximum(x, y))
        return out


def grid_points(words: np.ndarray, doc: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods): multiples of a period where the words agree with those of the next three multiples. sizes: of documents, never rising."""
    places, periods = [], []
    for p in range(1, (int(sizes[0]) // PERIODS if len(sizes) else 0) + 1):
        some = int(np.searchsorted(-sizes, -max(PERIODS * p, LONG), "right"))
        if not some:
            break
        on = words[: first[some - 1] + sizes[some - 1] : p]
        same = on[1:] == on[:-1]
        found = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
        if len(found) and len(found := found[doc[found] == doc[found + 3 * p]]):
            places.append(found)
            periods.append(np.full(len(found), p))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, a text being numbers of its words from 0 on; by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= LONG), key=lambda k: -len(texts[k]))
    if not order:
        return out
    sizes = np.array([len(texts[k]) for k in order])
    first = np.cumsum(sizes + 1) - sizes
    highest = max(int(texts[k].max()) for k in order) + 1
    words = np.empty(first[-1] + sizes[-1] + 1, dtype=np.int64)
    words[0] = highest
    for n, k in enumerate(order):
        words[first[n] : first[n] + sizes[n]] = texts[k]
        words[first[n] + sizes[n]] = highest + n + 1
    doc = np.repeat(np.arange(len(order)), sizes + 1)
    doc = np.concatenate([[0], doc])
    places, periods = grid_points(words, doc, first, sizes)
    if not len(places):
        return out
    # Documents with a point, and the word between them, are what is sorted.
    asked = np.zeros(len(order), dtype=bool)
    asked[doc[places]] = True
    stays = np.concatenate([[True], asked[doc[1:]]])
    moved = np.cumsum(stays) - 1
    some, of = words[stays], doc[stays]
    at = moved[places]
    forward = Extensions(some, of)(at, at + periods)
    last = len(some) - 1
    before = at > 0
    backward = np.zeros(len(at), dtype=np.int64)
    ends = np.concatenate([of[1:], of[-1:]])  # reversed, a document ends with the word before it
    backward[before] = Extensions(some[::-1], ends[-1] - ends[::-1])(last - (at[before] - 1), last - (at[before] - 1 + periods[before]))
    length = forward + backward + periods
    good = length >= np.maximum(LONG, PERIODS * periods)
    start, length, periods, places = places[good] - backward[good], length[good], periods[good], places[good]
    # Multiples of a period span the same stretch; the smallest counts.
    by = np.lexsort((periods, length, start))
    start, length, periods, places = start[by], length[by], periods[by], places[by]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(start) else np.empty(0, dtype=bool)
    found = sorted(zip(doc[places[once]].tolist(), start[once].tolist(), periods[once].tolist(), length[once].tolist()))
    for n, s, p, k in found:
        out[order[n]].append((s - int(first[n]), k, p))
    return out


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """By place, the word that stands there: those of a tenth of all ids repeat from some place on."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (by start, then period), best (the run with most periods), collapsed (the words left, joined by a space).

    Of a run the first period is left. plant: texts are changed as `planted` says before.
    """

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: at ASCII white space only
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
                if n > TOGETHER:
                    yield found(ids, texts)
                    ids, texts, n = [], [], 0
            yield found(ids, texts)

    def found(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        at = [planted(len(words), i) if plant else np.arange(len(words)) for i, words in zip(ids, texts)]
        numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))[a] for words, a in zip(texts, at)]
        runs, best, left = runs_of(numbers), [], []
        for words, a, own in zip(texts, at, runs):
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            top = None
            for s, n, p in own:
                edge[s + p] += 1
                edge[s + n] -= 1
                if top is None or n * top[2] > top[1] * p:
                    top = (s, n, p)
            stay = a[np.cumsum(edge)[:-1] == 0].tolist()
            best.append(top)
            left.append(b" ".join([words[k] for k in stay]).decode("utf-8", "surrogatepass"))
        as_rows = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([[as_rows(r) for r in own] for own in runs], RUNS),
             pa.array([as_rows(r) for r in best], RUNS.value_type), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(together, f"doc_id long, n_words long, runs {RESULT}, best {RESULT[6:-1]}, collapsed string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its number of runs, the one with most periods, and digests of all runs and of the words that are left."""
    rows = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
