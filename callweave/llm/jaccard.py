"""Operator 7: n-gram Jaccard join by signature trees.

A document's set holds its distinct shingles of five words, as 64-bit hashes. Documents of equal sets
are one class, and classes are compared. Sets of similarity t or more share one of their first
n - ceil(t n) + 1 shingles in any order that holds for all; here shingles that many sets have come
last, which changes no result, only how large the groups of sets with a shingle in common are. In
each group a signature tree holds bitmaps: a node has the OR of the bitmaps below, the range of their
sizes and what collisions hide at most. Two nodes are descended together and left as soon as the
largest possible overlap, or that both are one component already, rules them out.

A shingle that more sets have than fit a block is common to several blocks. At first the members of each
block are compared with each other and with the first block of the shingle: as many pairs of blocks as
there are blocks. Sets that are one component by then need no comparing among each other, so that the
second turn deals the sets of such a shingle to blocks anew, in order of components, and leaves out
whatever lies in one component.

What is left is compared set by set in two turns: first each set with its smallest partner and with
the one that its bitmap is most like, which joins groups of near copies of any size by about as many
links as they have members, then every pair of different components that the trees leave. Pairs that
hang together are compared in one cell, so that a set travels once for all its pairs; where too many
hang together, in the cells of the trees that left them. Sets are compared by all 64 bits of each hash.

Defined cases: null and blank texts have an empty set and link with nothing; fewer than five words
are one shingle; texts are read whole; a null doc_id takes part but names no component, unless all of
its component are null; rows that repeat an id or a text are returned each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small, table
from .components import components

SHINGLE, PERCENT = 5, 80
#: A shingle is common if so many sets have it; so many of the most common ones are known to all tasks at most.
COMMON, MOST_COMMON = 100, 1_000_000
#: Shingles of a task that are counted together, and texts that are split together.
TOGETHER, SOME = 1_000_000, 256
#: Shingles from which on sets that hang together are dealt to several cells.
CELL = 400_000
#: Sets with a common shingle are dealt to tasks, so many to each.
DEALT = 4_096
#: Fewest bits of a signature (it has two for each member of the set at least), members of a tree's block, children of a node.
BITS, BLOCK, FAN = 1024, 512, 8
#: Estimated similarity, in percent, from which on a pair is compared in the first turn; all others that count wait for the second.
LIKELY = 74
#: Bytes of signatures that are compared at once.
AT_ONCE = 1 << 23
#: Broadcast up to so many ids.
SMALL_IDS = 1_000_000


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k consecutive words; A-Z lower-cased, split at ASCII white space."""
    for at in range(0, len(texts), SOME):
        part = texts.slice(at, SOME).fill_null("").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(part)
        coded = lists.flatten().dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w.encode().lower()) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        index = coded.indices.to_numpy()
        real = index != (pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1)  # blanks at the ends of a text
        h = hashes[index[real]]
        ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()]
        g = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
        for i in range(k):
            g = (g ^ h[i : len(g) + i]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            else:
                yield np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), seed=b - a)] if b > a else [], dtype=np.uint64)


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few texts each."""
    for part in parts:
        for at in range(0, part.num_rows, SOME):
            yield part.slice(at, SOME)


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(s: np.ndarray) -> bytes:
    """A power of two of bits, so many that unrelated sets of this size differ in enough of them; a longer one folds into a shorter one."""
    size = max(BITS, 1 << int(np.ceil(np.log2(max(1, 2 * len(s))))))
    bits = np.zeros(size, dtype=bool)
    bits[(s >> np.uint64(17)) % np.uint64(size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unfolded(raws: list[bytes], size: int) -> np.ndarray:
    """Bitmaps repeated up to so many bytes: rows of 64-bit words. A token that two sets share has its bit in both."""
    return np.frombuffer(b"".join([r * (size // len(r)) for r in raws]), dtype=np.uint64).reshape(-1, size // 8)


def hidden_tokens(raws: list[bytes], n: np.ndarray) -> np.ndarray:
    """How many tokens of each set collide with another one in its bitmap."""
    return n - np.array([int.from_bytes(r, "little").bit_count() for r in raws], dtype=np.int64)


def estimate(shared: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity by bitmaps, as shares of bits: what a and b have in common beyond chance."""
    chance = a * b
    overlap = np.minimum(na, nb) * np.clip((shared - chance) / np.maximum(1e-9, np.minimum(a, b) - chance), 0, 1)
    return overlap / (na + nb - overlap)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, bits; rows with n_shingles -1 hold shingles that several sets of a task have, and how many."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def common() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return batch([None], [-1], [0], [b""], [tokens[often].astype(np.int64)], [counts[often]])

        for part in slices(parts):
            sets = list(shingle_sets(part.column("text")))
            of = [class_of(s) for s in sets]
            yield batch(part.column("doc_id"), [len(s) for s in sets], of, [bitmap(s) for s in sets], [None] * len(sets), [None] * len(sets))
            for c, s in zip(of, sets):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                    if size > TOGETHER:
                        yield common()
                        held, size = [], 0
        if held:
            yield common()

    def batch(*columns) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ("doc_id", "n_shingles", "class", "bits", "tokens", "counts")
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, bits binary, tokens array<long>, counts array<long>")


def common_shingles(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last, sorted, and about how many sets have them: a bounded number, the most common ones."""
    rows = found.filter("n_shingles = -1").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    sums = rows.groupBy("x.tokens").agg(F.sum("x.counts").alias("n")).filter(F.col("n") >= COMMON)
    told = sums.orderBy(F.desc("n"), "tokens").limit(MOST_COMMON).toPandas()
    tokens = told["tokens"].to_numpy(dtype=np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], told["n"].to_numpy(dtype=np.int64)[order]


BLOCKS = "token long, salt int, block int, many boolean, gid long, low long, high long, members array<long>"


def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the classes of a token and salt; rows come sorted by token, salt, part (if there is one) and class.

    many: the token has other blocks, or may have them in other tasks (a salt of 0 or more); low, high: the range of parts.
    """

    def rows(out: list) -> pa.RecordBatch:
        ids = [xxhash.xxh64_intdigest(m.tobytes()) - (1 << 63) for *_, m, _ in out]
        ends = [(int(p.min()), int(p.max())) for *_, p in out]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = ([r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [r[3] for r in out], ids, [e[0] for e in ends], [e[1] for e in ends], [r[4] for r in out])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "salt", "block", "many", "gid", "low", "high", "members"])

    def pair_rows(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> pa.RecordBatch:
        n, first, last = len(a), np.minimum(a, b), np.maximum(a, b)
        gid = ((first * np.int64(-7046029254386353131)) ^ (last + (first >> np.int64(29)))) * np.int64(-3335678366873096957)
        both = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(np.stack([first, last], axis=1).ravel()))
        none = pa.array(np.full(n, -1, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens), none, pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.zeros(n, dtype=bool)), pa.array(gid), pa.array(np.minimum(pa_, pb)), pa.array(np.maximum(pa_, pb)), both],
            ["token", "salt", "block", "many", "gid", "low", "high", "members"])

    now, block = None, 0
    empty = np.empty(0, dtype=np.int64)
    members = held = empty
    for batch in parts:
        t, salt, c = (batch.column(k).to_numpy() for k in ("token", "salt", "class"))
        part = batch.column("part").to_numpy() if "part" in batch.schema.names else c
        if not len(t):
            continue
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])])
        fresh = np.concatenate([[True], new[1:] | (c[1:] != c[:-1])])
        t, salt, c, part, new = t[fresh], salt[fresh], c[fresh], part[fresh], new[fresh]
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(t))
        inner = np.zeros(len(starts), dtype=bool)
        inner[1:-1] = ((stops - starts)[1:-1] <= 2) & (salt[starts][1:-1] < 0)  # the first and last token may go on in another batch
        two = starts[inner & (stops - starts == 2)]
        if len(two):
            yield pair_rows(t[two], c[two], c[two + 1], part[two], part[two + 1])
        out = []
        for a, b in zip(starts[~inner].tolist(), stops[~inner].tolist()):
            key = (int(t[a]), int(salt[a]))
            if key != now:
                if now is not None and (block or len(members) > 1 or now[1] >= 0):
                    out.append((*now, block, block > 0 or now[1] >= 0, members, held))
                now, block, members, held = key, 0, empty, empty
            from_ = a + (len(members) > 0 and c[a] == members[-1])
            members, held = np.concatenate([members, c[from_:b]]), np.concatenate([held, part[from_:b]])
            while len(members) > BLOCK:
                out.append((*now, block, True, members[:BLOCK], held[:BLOCK]))
                block, members, held = block + 1, members[BLOCK:], held[BLOCK:]
        if out:
            yield rows(out)
    if now is not None and len(members) and (block or len(members) > 1 or now[1] >= 0):
        yield rows([(*now, block, block > 0 or now[1] >= 0, members, held)])


def token_blocks(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """BLOCKS of the classes that share a shingle of their prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast((common[0], (1 + common[1] // DEALT).astype(np.int64)))

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late_ones, salts = shared.value
        seen = set()
        for part in slices(parts):
            tokens, of, salt = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
            for s in shingle_sets(part.column("text")):
                c = class_of(s)
                if len(s) and c not in seen:
                    seen.add(c)
                    at = np.minimum(np.searchsorted(late_ones, s), max(0, len(late_ones) - 1))
                    late = late_ones[at] == s if len(late_ones) else np.zeros(len(s), dtype=bool)
                    first = s[~late]
                    k = prefix_length(len(s))
                    dealt = salts[at[late]] if len(late_ones) else np.empty(0, dtype=np.int64)
                    tokens.append(np.concatenate([first, s[late]])[:k])
                    salt.append(np.concatenate([np.full(len(first), -1), np.where(dealt > 1, c % np.maximum(dealt, 1), -1)])[:k].astype(np.int32))
                    of.append(np.full(len(tokens[-1]), c, dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).astype(np.int64), "salt": np.concatenate(salt), "class": np.concatenate(of)})

    by_token = docs.select("text").mapInArrow(prefixes, "token long, salt int, class long").repartition("token", "salt").sortWithinPartitions("token", "salt", "class")
    return by_token.mapInArrow(gather, BLOCKS)


def block_pairs(blocks: DataFrame, every: bool) -> DataFrame:
    """(gid, side, class): blocks of tokens that have several, each with itself and with the first one, or with every other; blocks within one component are left out."""
    blocks = blocks.filter("many")
    side = lambda members, k: F.transform(members, lambda c: F.struct(F.lit(k).alias("side"), c.alias("class")))
    own = blocks.filter("low < high").select("gid", side("members", 0).alias("m"))
    other = blocks if every else blocks.filter("block = 0 and salt <= 0")
    other = other.select("token", F.col("gid").alias("with_gid"), F.col("low").alias("with_low"), F.col("high").alias("with_high"), F.col("members").alias("with"))
    pairs = blocks.join(other, "token").filter("gid < with_gid" if every else "gid <> with_gid").filter("least(low, with_low) < greatest(high, with_high)")
    pairs = pairs.select(F.xxhash64(F.least("gid", "with_gid"), F.greatest("gid", "with_gid")).alias("gid"), F.concat(side("members", 0), side("with", 1)).alias("m"))
    return own.unionByName(pairs).dropDuplicates(["gid"]).select("gid", F.explode("m").alias("m")).select("gid", "m.side", "m.class")


def first_groups(blocks: DataFrame) -> DataFrame:
    """(gid, side, class): what is compared at first."""
    alone = blocks.filter("not many").dropDuplicates(["gid"]).select("gid", F.lit(0).alias("side"), F.explode("members").alias("class"))
    return alone.unionByName(block_pairs(blocks, every=False))


def groups_apart(blocks: DataFrame, again: DataFrame, members: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(gid, side, class, n, part): groups with more than one component, of `again` and of the tokens of `blocks`; members(class, n, ...), parts(class, part)."""
    part = F.coalesce("part", "class").alias("part")
    alone = again.select("gid", "side", "class", "n").join(parts, "class", "left").select("gid", "side", "class", "n", part)
    mixed = alone.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("gid")
    alone = alone.join(mixed, "gid", "left_semi")
    rows = blocks.select("token", F.explode("members").alias("class")).join(parts, "class", "left").select("token", "class", part)
    mixed = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).filter("low < high").select("token", "size")
    rows = rows.join(mixed, "token").withColumn("salt", F.pmod("class", F.lit(1) + F.floor(F.col("size") / DEALT)).cast("int"))
    again = rows.select("token", "salt", "part", "class").repartition("token", "salt").sortWithinPartitions("token", "salt", "part", "class")
    again = scratch.keep(again.mapInArrow(gather, BLOCKS), "blocks-again")
    sizes = members.select("class", "n").distinct()
    pairs = block_pairs(again, every=True).join(sizes, "class").join(parts, "class", "left").select("gid", "side", "class", "n", part)
    return alone.unionByName(pairs)


def needed(na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Smallest overlap that makes sets of these sizes similar."""
    return -(-percent * (na + nb) // (100 + percent))


class Tree:
    """A signature tree over sets, in order of their sizes: levels of nodes, the leaves first."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, part: np.ndarray, hidden: np.ndarray):
        order = np.lexsort((part, n))
        n, bits, part, hidden = n[order], bits[order], part[order], hidden[order]
        self.fill = np.bitwise_count(bits).sum(axis=1) / (64 * bits.shape[1])
        self.order, self.levels = order, [(n, n, hidden, bits, part, np.ones(len(n), dtype=bool))]
        while len(self.levels[-1][0]) > FAN:
            low, high, hidden, bits, part, one = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            same = (np.minimum.reduceat(part, at) == np.maximum.reduceat(part, at)) & np.logical_and.reduceat(one, at)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at), np.bitwise_or.reduceat(bits, at), part[at], same))


def traverse(a: Tree, b: Tree, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members (numbers in a and in b) that similarity isn't ruled out for, and its estimate; same: a is b, each pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[la][0])), np.arange(len(b.levels[lb][0])), indexing="ij"))
    most = max(16, AT_ONCE // (8 * a.levels[0][3].shape[1]))
    while True:
        keep_i, keep_j, score = [], [], [np.empty(0)]
        for at in range(0, len(i), most):
            x, y = i[at : at + most], j[at : at + most]
            if same and la == lb:
                x, y = x[x <= y], y[x <= y]
            (lo, hi, hid, bits, part, one), (lo2, hi2, hid2, bits2, part2, one2) = a.levels[la], b.levels[lb]
            ok = ~(one[x] & one2[y] & (part[x] == part2[y]))
            ok &= np.minimum(hi[x], hi2[y]) >= needed(lo[x], lo2[y])
            x, y = x[ok], y[ok]
            shared = np.bitwise_count(bits[x] & bits2[y]).sum(axis=1)
            ok = shared + np.minimum(hid[x], hid2[y]) >= needed(lo[x], lo2[y])
            x, y, shared = x[ok], y[ok], shared[ok]
            keep_i.append(x)
            keep_j.append(y)
            if la == 0 and lb == 0:
                score.append(estimate(shared / (64 * bits.shape[1]), a.fill[x], b.fill[y], lo[x], lo2[y]))
        i, j = np.concatenate(keep_i) if keep_i else i, np.concatenate(keep_j) if keep_j else j
        if la == 0 and lb == 0:
            score = np.concatenate(score)
            if same:
                i, j, score = i[i != j], j[i != j], score[i != j]
            return a.order[i], b.order[j], score
        if la >= lb:
            i, j, la = *down(i, j, len(a.levels[la - 1][0])), la - 1
        if lb > la:
            j, i, lb = *down(j, i, len(b.levels[lb - 1][0])), lb - 1


def down(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node of i replaced by its children."""
    child = (i[:, None] * FAN + np.arange(FAN)).ravel()
    return child[child < n], np.repeat(j, FAN)[child < n]


PAIRS = "a long, b long, score double, size int, gid long, slice_a int, slice_b int, turn int"
#: A group that leaves more than so many pairs for each member is descended again after the first turn.
MANY_PAIRS = 8


def picked(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which pairs (a > b) of a group hold some member's smallest or best partner."""
    both, with_, number = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    smallest = np.lexsort((b, a))
    best = np.lexsort((with_, -np.tile(score, 2), both))
    first = lambda order, key: order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
    return np.unique(np.concatenate([first(smallest, a), number[first(best, both)]]))


def candidates(members: DataFrame, bits: DataFrame, every: bool, scratch: Scratch) -> DataFrame:
    """members(gid, side, class, n, part), bits(class, bits) -> pairs (a, b) of different parts that the trees leave: score, turn, and the largest cell (size, gid, slice_a, slice_b) to compare them in.

    turn: 1 for a set's smallest and best partner in a group if they are likely similar, else 2; where a group would leave too
    many of the latter, one row of turn 3 and a null pair names it instead. every: all pairs are of turn 2.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in parts:
            now = pa.Table.from_batches([part] if rest is None else [rest, part]).combine_chunks().to_batches()
            if not now:
                continue
            pa.default_memory_pool().release_unused()
            gid = now[0].column("gid").to_numpy()
            end = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if gid[0] != gid[-1] else 0
            rest = now[0].slice(end)  # the last group may go on
            yield work(now[0].slice(0, end))
        if rest is not None:
            yield work(rest)

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        gid, side, of, n, part = (rows.column(c).to_numpy() for c in ("gid", "side", "class", "n", "part"))
        raws = rows.column("bits").to_pylist()
        hidden, width = hidden_tokens(raws, n), np.array([len(r) for r in raws], dtype=np.int64)
        starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.empty(0, dtype=int)
        size = np.diff(np.append(starts, len(gid)))
        out = []

        def send(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int, slices: int, turn: np.ndarray) -> None:
            """Rows i with rows j of one group, or of groups of two."""
            swap = of[i] < of[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append((of[i], of[j], score, np.full(len(i), k), gid[i], np.abs(of[i]) % slices, np.abs(of[j]) % slices, turn))

        two = starts[size == 2]  # groups of two are trees of two leaves: all at once
        if len(two):
            two = two[(part[two] != part[two + 1]) & (np.minimum(n[two], n[two + 1]) >= needed(n[two], n[two + 1]))]
        wide = np.maximum(width[two], width[two + 1])
        for size_of in np.unique(wide):
            for block in np.array_split(two[wide == size_of], 1 + int(size_of) * int((wide == size_of).sum()) // AT_ONCE):
                shared = unfolded([raws[i] for i in block], size_of) & unfolded([raws[i + 1] for i in block], size_of)
                shared = np.bitwise_count(shared).sum(axis=1)
                fill, fill_too = ((n[i] - hidden[i]) / (8 * width[i]) for i in (block, block + 1))
                score = estimate(shared / (8 * size_of), fill, fill_too, n[block], n[block + 1])
                ok = shared + np.minimum(hidden[block], hidden[block + 1]) >= needed(n[block], n[block + 1])
                send(block[ok], block[ok] + 1, score[ok], 2, 1, np.where((score[ok] >= LIKELY / 100) & (not every), 1, 2))
        for at, k in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
            own = np.arange(at, at + k)
            left, right = own[side[own] == 0], own[side[own] == 1]
            pairs = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]

            def tree(members: np.ndarray, wide: int) -> Tree:
                return Tree(n[members], unfolded([raws[i] for i in members], wide), part[members], hidden[members])

            # Similar sets have bitmaps of one width or of neighbouring ones.
            for w in np.unique(width[own]).tolist():
                for one, two_ in ((left, right), (right, left)) if len(right) else ((left, left),):
                    x, wider = one[width[one] == w], two_[width[two_] == 2 * w]
                    y = two_[width[two_] == w]
                    if len(x) and len(wider):
                        i, j, score = traverse(tree(x, 2 * w), tree(wider, 2 * w), False)
                        pairs.append((x[i], wider[j], score))
                    if len(x) and len(y) and one is left:
                        first = tree(x, w)
                        i, j, score = traverse(first, tree(y, w), False) if len(right) else traverse(first, first, True)
                        pairs.append((x[i], y[j], score))
            i, j, score = (np.concatenate(c) for c in zip(*pairs))
            apart = part[i] != part[j]
            i, j, score = i[apart], j[apart], score[apart]
            turn, slices_ = np.full(len(i), 2), 1 + int(n[own].sum()) // CELL
            if not every and len(i):
                likely = np.flatnonzero(score >= LIKELY / 100)
                if len(likely):
                    turn[likely[picked(np.maximum(of[i[likely]], of[j[likely]]), np.minimum(of[i[likely]], of[j[likely]]), score[likely])]] = 1
                if np.count_nonzero(turn == 2) > MANY_PAIRS * k:
                    i, j, score, turn = i[turn == 1], j[turn == 1], score[turn == 1], turn[turn == 1]
                    out.append(tuple(np.array([x]) for x in (0, 0, 0.0, k, gid[at], 0, 0, 3)))
            send(i, j, score, k, slices_, turn)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], ["a", "b", "score", "size", "gid", "slice_a", "slice_b", "turn"])

    by_group = members.join(bits, "class").select("gid", "side", "class", "n", "bits", "part").repartition("gid").sortWithinPartitions("gid", "side", "class")
    pairs = by_group.mapInArrow(run, PAIRS)
    # Of the groups that hold a pair the largest one compares it, where its sets are needed most; each group of turn 3 stays by itself.
    cell = F.struct("size", "gid", "slice_a", "slice_b")
    redone = F.when(F.col("turn") == 3, F.col("gid")).alias("again")
    pairs = pairs.groupBy("a", "b", redone).agg(F.max("score").alias("score"), F.min("turn").alias("turn"), F.max(cell).alias("cell"))
    return scratch.keep(pairs.select("a", "b", "score", "turn", "again", "cell.gid", "cell.slice_a", "cell.slice_b"), "picks")


def first_turn(pairs: DataFrame) -> DataFrame:
    """Of the pairs of turn 1 those of each set with its smallest partner and with its best one."""
    pairs = pairs.filter("turn = 1")
    cell = F.struct("gid", "slice_a", "slice_b")
    smallest = pairs.groupBy("a").agg(F.min(F.struct("b", cell.alias("cell"))).alias("p")).select("a", "p.b", "p.cell")
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    best = pairs.select(ends.alias("e"), "a", "b", "score", cell.alias("cell")).groupBy("e.u").agg(F.max(F.struct("score", (-F.col("e.v")).alias("v"), "a", "b", "cell")).alias("p"))
    return smallest.unionByName(best.select("p.a", "p.b", "p.cell")).distinct().select("a", "b", "cell.*")


def second_turn(pairs: DataFrame, done: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs of different components that the first turn hasn't compared; parts(class, part)."""
    left = pairs.filter("turn < 3").select("a", "b", "gid", "slice_a", "slice_b").join(done.select("a", "b"), ["a", "b"], "left_anti")
    for end in "ab":
        left = left.join(parts.select(F.col("class").alias(end), F.col("part").alias(f"part_{end}")), end, "left")
    return left.filter("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b", "gid", "slice_a", "slice_b")


def similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Which of pairs(a, b, gid, slice_a, slice_b) are similar, by the sets themselves; classes(class, n, doc_id, named).

    Pairs that hang together share a cell if their sets fit one; the others stay in the cells of their trees.
    """
    together = components(pairs.select("a", "b"))
    sizes = together.join(classes.select(F.col("class").alias("id"), "n"), "id").groupBy("component").agg(F.sum("n").alias("size")).filter(F.col("size") <= CELL)
    fits = together.join(sizes.select("component"), "component").select(F.col("id").alias("a"), "component")
    apart = F.col("component").isNull()
    pairs = scratch.keep(pairs.join(fits, "a", "left").select(
        "a", "b", F.coalesce("component", "gid").alias("gid"), *[F.when(apart, F.col(c)).otherwise(-1).alias(c) for c in ("slice_a", "slice_b")]), "placed-pairs")
    cell = ["gid", "slice_a", "slice_b"]
    roles = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("class"), *cell).distinct(), "roles")
    at = classes.join(roles.select("class").distinct(), "class", "left_semi")
    ids = small(at.filter("named > 0").select("doc_id").distinct(), SMALL_IDS)
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    if scratch.any(at.filter("named = 0")):  # sets that only rows without an id have
        texts = texts.unionByName(docs.filter("doc_id is null").select("text"))

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(parts):
            of, tokens = [], []
            for s in shingle_sets(part.column("text")):
                if (c := class_of(s)) not in seen:
                    seen.add(c)
                    of.append(c)
                    tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(tokens, pa.binary())], ["class", "tokens"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, its sets before its pairs; a set that several tasks made comes several times."""
        now, held, a, b = None, {}, [], []
        for part in parts:
            for of, with_, *key, tokens in zip(*(part.column(c).to_pylist() for c in ("class", "b", *cell)), part.column("tokens")):
                if key != now:
                    now, held = key, {}
                if with_ is None:
                    if of not in held:
                        held[of] = np.frombuffer(tokens.as_py(), dtype=np.uint64)
                    continue
                x, y = held[of], held[with_]
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    a.append(of)
                    b.append(with_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
            pa.default_memory_pool().release_unused()

    sent = texts.mapInArrow(sets, "class long, tokens binary").join(small(roles, SMALL_IDS), "class")
    rows = sent.select("class", F.lit(None).cast("long").alias("b"), *cell, "tokens").unionByName(pairs.select(F.col("a").alias("class"), "b", *cell, F.lit(None).cast("binary").alias("tokens")))
    in_order = rows.repartition(*cell).sortWithinPartitions(*cell, F.col("b").isNotNull(), "class")
    found = scratch.keep(in_order.mapInArrow(compare, "a long, b long").distinct(), "similar")
    scratch.drop("placed-pairs", "roles")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, with a row for each document."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.keep(signatures(docs), "signatures")
    sets = found.filter("n_shingles >= 0")
    classes = sets.filter("n_shingles > 0").groupBy("class").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("named"))
    classes = scratch.keep(classes, "classes")
    blocks = scratch.keep(token_blocks(docs, common_shingles(found)), "blocks")
    members = scratch.keep(first_groups(blocks).join(classes.select("class", "n"), "class"), "members")
    bits = scratch.keep(sets.join(members.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("bits").alias("bits")), "bits")
    pairs = candidates(members.withColumn("part", F.col("class")), bits, False, scratch)
    done = scratch.keep(first_turn(pairs), "pairs")
    links = similar(done, docs, classes, scratch)
    parts = components(links).select(F.col("id").alias("class"), F.col("component").alias("part"))
    left = second_turn(pairs, done, parts)
    again = members.join(pairs.filter("turn = 3").select(F.col("again").alias("gid")), "gid", "left_semi")
    hot = blocks.filter("many")
    if scratch.any(hot) or scratch.any(again):
        groups = scratch.keep(groups_apart(hot, again, members, parts, scratch), "groups-apart")
        left = left.unionByName(second_turn(candidates(groups, bits, True, scratch), done, parts))
    left = scratch.keep(left.groupBy("a", "b").agg(F.max(F.struct("gid", "slice_a", "slice_b")).alias("cell")).select("a", "b", "cell.*"), "pairs")
    more = similar(left, docs, classes, scratch)
    scratch.drop("blocks", "blocks-again", "members", "groups-apart", "bits", "picks", "pairs")
    parts = components(links.unionByName(more)).select(F.col("id").alias("class"), F.col("component").alias("part"))
    named = classes.join(parts, "class", "left").select("class", F.coalesce("part", "class").alias("part"), "doc_id")
    lowest = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_class = named.select("class", "part").join(lowest, "part").select("class", "component_id")
    linked = sets.filter("n_shingles > 0").select("doc_id", "n_shingles", "class").join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The set size and the component of every document; one without words is its own component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g, least(len(ws), 5) AS k
      FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.k = q.k AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.to_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id, n.n
"""
