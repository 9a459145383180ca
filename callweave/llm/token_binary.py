"""Operator 6: token ids in flat binary files.

Format, one set of files for each range of ids: `.bin` holds token ids as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32), `.off` unsigned 64-bit offsets into it (one
more than documents), `.ids` the signed 64-bit document ids and `.nul` a byte each, 1 for a null id.
The manifest lists the files in order with their counts and bases, which are prefix sums of the
counts, so that base + local offset numbers the tokens of the whole corpus.

Tasks write under names of their own and the manifest names only files of tasks that ended well, so
a task that is run again does no harm. Files go through pyarrow's file systems; local ones are read
by memory map.

Defined cases: a null text is empty and yields the end id alone; null ids come first; rows of one
id follow each other by the hash of their text; with a byte-level pre-tokenizer and no normalizer texts
are encoded word by word, cut at single spaces between words, which gives the same ids and lets each
different word be encoded once; texts that hold a NUL or the string of an added token, which the library
turns into that token, are encoded whole, and so are all texts with other tokenizers; an empty table
gives files of no document and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir, table

#: Characters that a byte-level BPE surely takes for visible ones, and for letters.
VISIBLE, LETTER = "!-~\u00C0-\u024F", "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: Texts with a space beside something else than two visible characters.
ODD_SPACE = f"[^{VISIBLE}] |^ | $| [^{VISIBLE}]"
#: Words that a Python worker remembers at most: those of two generations.
REMEMBERED = 500_000
#: Documents encoded together, and tasks that read files at most.
TOGETHER, READERS = 2048, 10_000
MANIFEST = "part int, path string, width int, n_docs long, n_tokens long"


class Words:
    """Ids of words that were encoded; when a generation is full, the older one goes, but for the words that were asked for since."""

    def __init__(self):
        self.new, self.old = {}, {}

    def missing(self, words: list[str]) -> list[str]:
        if len(self.new) > REMEMBERED // 2:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for w in words:
            if w not in new:
                if (ids := old.get(w)) is None:
                    out.append(w)
                else:
                    new[w] = ids
        return out


#: Words that this Python worker has encoded, by tokenizer; it runs many tasks.
_known: dict[int, Words] = {}


def remembered(tokenizer: int) -> Words:
    return _known.setdefault(tokenizer, Words())


def whole_texts(tokenizer: str) -> str:
    """The form of texts that have to be encoded whole with this tokenizer file."""
    spec = json.loads(tokenizer)
    kind = spec.get("pre_tokenizer") or {}
    by_word = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not spec.get("normalizer")
    added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
    return "|".join(["\\x00", *added]) if by_word else ""


def file_system(uri: str):
    """(file system, path) of a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), urlsplit(uri).path)


def cut_words(texts: pa.Array) -> pa.Array:
    """Each text as a list of pieces that encode on their own to the same ids as in the text.

    A word of a byte-level BPE begins at a single space between visible characters, and at a
    punctuation mark after a letter (not at an apostrophe). Other places are not cut.
    """
    odd = pc.match_substring_regex(texts, ODD_SPACE)
    usual = pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 ")
    rest = pc.replace_substring_regex(pc.if_else(odd, texts, ""), f"([{VISIBLE}]) ([{VISIBLE}])", "\\1\0 \\2")
    spaced = pc.if_else(odd, rest, usual)
    return pc.split_pattern(pc.replace_substring_regex(spaced, f"([{LETTER}])([!-&(-/:-@\\[-`{{-~])", "\\1\0\\2"), "\0")


def encode(tokenizer, texts: pa.Array, known: Words, width: int, whole: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts after each other, number of ids of each); the library encodes a word once, `known` remembers it. whole: the form of texts that aren't cut."""
    texts = texts.fill_null("").cast(pa.large_string())
    uncut = pc.match_substring_regex(texts, whole)
    lists = cut_words(pc.if_else(uncut, "", texts))
    if pc.any(uncut).as_py():
        lists = pa.array([[t] if z else words for t, z, words in zip(texts.to_pylist(), uncut.to_pylist(), lists.to_pylist())], pa.list_(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    new = known.missing(words)
    form = re.compile(whole)
    for some, plain in (([w for w in new if not form.search(w)], True), ([w for w in new if form.search(w)], False)):
        tokenizer.encode_special_tokens = plain  # words hold no added token: the library needn't look for them
        for w, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            known.new[w] = np.array(e.ids, dtype=f"<u{width}").tobytes()
    ids = [known.new[w] for w in words]
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
    flat, first, at = np.frombuffer(b"".join(ids), dtype=f"<u{width}"), np.cumsum(n) - n, coded.indices.to_numpy()
    ends = np.cumsum(n[at])
    out = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n[at] - first[at], n[at])]
    return out, np.diff(np.concatenate([[0], ends])[lists.offsets.to_numpy()])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) in ascending order of ids; the manifest: part, path, width, n_docs, n_tokens, base."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # of fixed size
    whole = whole_texts(vocabulary.value)
    width = 2 if max(Tokenizer.from_str(vocabulary.value).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        known = remembered(zlib.crc32(vocabulary.value.encode()))
        part = TaskContext.get().partitionId()
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        dtype, at, ids, nulls = f"<u{width}", [np.zeros(1, dtype=np.int64)], [], []
        with files.open_output_stream(f"{root}/{name}.bin") as out:
            for batch in parts:
                for k in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(k, TOGETHER)
                    tokens, n = encode(tokenizer, some.column("text"), known, width, whole)
                    ends = np.cumsum(n)
                    out.write(np.insert(tokens, ends, end_id).astype(dtype).tobytes())
                    at.append(at[-1][-1] + ends + np.arange(1, len(n) + 1))
                    ids.append(some.column("doc_id").fill_null(0).to_numpy())
                    nulls.append(some.column("doc_id").is_null().to_numpy(zero_copy_only=False))
        at = np.concatenate(at)
        for kind, values, form in (("off", [at], "<u8"), ("ids", ids, "<i8"), ("nul", nulls, "u1")):
            with files.open_output_stream(f"{root}/{name}.{kind}") as out:
                for v in values:
                    out.write(v.astype(form).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "width": pa.array([width], pa.int32()), "n_docs": [len(at) - 1], "n_tokens": [int(at[-1])]})

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = keep(ranged.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def opened(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped if local, read otherwise."""
    files, path = file_system(uri)
    info = files.get_file_info(path)
    if not info.size:
        return np.empty(0, dtype=dtype)
    if files.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                tokens, offsets, ids, nulls = (opened(f"{row.path}.{k}", d) for k, d in (("bin", f"<u{row.width}"), ("off", "<u8"), ("ids", "<i8"), ("nul", "u1")))
                offsets = offsets.astype(np.int64)
                for at in range(0, len(ids), 4096):
                    span = range(at, min(at + 4096, len(ids)))
                    yield pd.DataFrame({
                        "doc_id": [None if nulls[i] else str(ids[i]) for i in span],
                        "start": row.base + offsets[span.start : span.stop],
                        "n_tokens": np.diff(offsets[span.start : span.stop + 1]),
                        "ids_crc32": [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in span],
                    })

    readers = max(1, min(READERS, manifest.count()))
    rows = manifest.repartition(readers, "part").mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_token_binary(spark, sf_dir: str) -> DataFrame:
    """Every document as the token files hold it; a null text is its end id alone."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
