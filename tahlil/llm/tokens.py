"""Problem 7: token ids of a whole corpus under a public tokenizer, by a table of distinct words.

1. Every batch splits its texts into words and reports its distinct words; a grouped count over all
   batches gives the table of words met in two batches or more, each encoded once.
2. The frequent part of the table, at most TABLE_WORDS words of at most TABLE_CHARS characters (a few MB,
   whatever the corpus), goes to all executors. A word outside it is rare; a worker encodes it when it meets it, and
   keeps it with the table for all its later batches and tasks. No word is dropped.
3. Each batch joins ids back to its words by position and puts them together by text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tahlil.functions.frequent import chosen
from tahlil.llm.pretoken import words
from tahlil.session import made, written

#: Bounds of the word table that is sent to the executors.
TABLE_WORDS, TABLE_CHARS = 1 << 17, 48
#: Words, and characters of words, that a worker keeps beside the table, before it begins anew.
KEPT_WORDS, KEPT_CHARS = 50_000, 2_000_000
#: Characters of text that one array operation handles at a time.
SLICE_CHARS = 2_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per process; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode_words(some: list[str], path: str) -> pa.ListArray:
    """Ids of each word."""
    got = [e.ids for e in tokenizer(path).encode_batch(some, add_special_tokens=False)] if some else []
    return pa.array(got, pa.list_(pa.int32()))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in slices of at most SLICE_CHARS bytes, at least one text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): in how many batches each word of at most TABLE_CHARS characters was met."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(0)):
                w = words(s)[0].unique()
                w = w.filter(pc.less_equal(pc.utf8_length(w), TABLE_CHARS)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([w], names=["word"])

    return docs.select(text).mapInArrow(distinct, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_table(docs: DataFrame, text: str, path: str) -> pa.Table:
    """The frequent words with their ids, at most TABLE_WORDS rows; nothing but this table and two bounded histograms reaches
    the driver."""
    counts = written(word_counts(docs, text).filter("n >= 2"), "words")
    keep = chosen(counts, "n", TABLE_WORDS, "word")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), encode_words(b.column(0).to_pylist(), path)], names=["word", "ids"])

    return counts.filter(keep).select("word").mapInArrow(encode, "word string, ids array<int>").toArrow()


class Known:
    """Words with their ids: the table, and what a worker has met beside it."""

    def __init__(self, table: pa.Table):
        self.table = dict(zip(table["word"].to_pylist(), range(len(table)), strict=True))
        ids = table["ids"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
        self.base_ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.base_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
        self._begin()

    def _begin(self) -> None:
        self.place, self.ids, self.ends, self.chars = dict(self.table), [self.base_ids], [self.base_ends], 0

    def lists(self, words: list[str], path: str) -> pa.ListArray:
        """Ids of each of some distinct words."""
        place = self.place
        fresh = [w for w in words if w not in place]
        if len(place) - len(self.table) + len(fresh) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self._begin()
            place = self.place
            fresh = [w for w in words if w not in place]
        if fresh:
            got = [e.ids for e in tokenizer(path).encode_batch(fresh, add_special_tokens=False)]
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            self.chars += sum(map(len, fresh))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())))
            self.ends.append((self.ends[-1][-1] + np.cumsum(sizes)).astype(np.int32))
        if len(self.ids) > 32:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        every = pa.ListArray.from_arrays(pa.array(np.concatenate(self.ends)), pa.array(np.concatenate(self.ids)))
        return every.take(pa.array(np.fromiter(map(place.__getitem__, words), np.int32, len(words))))


def ids_of(texts: pa.Array, known: Known, path: str) -> pa.ListArray:
    """Ids of each text: the ids of its words, by position; an empty list for a null or empty text."""
    w, bounds = words(texts)
    d = w.dictionary_encode()
    by_word = known.lists(d.dictionary.to_pylist(), path)  # ids of the slice's distinct words
    per_word = by_word.take(d.indices)  # of its words, in order
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(per_word).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), per_word.flatten().cast(pa.int32()))


def sent_table(docs: DataFrame, text: str, path: str):
    """The word table of a column, broadcast."""
    table = word_table(docs, text, path)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encoded(texts: pa.Array, sent, path: str) -> Iterator[tuple[int, pa.ListArray]]:
    """The ids of an array of texts in slices, each with the place where it begins."""
    known = made(sent, lambda x: Known(pa.ipc.open_stream(x).read_all().combine_chunks()))
    begin = 0
    for s in slices(texts):
        yield begin, ids_of(s, known, path)
        begin += len(s)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` without the column `text`, with its token ids as ARRAY<INT> in `out`.

    A null and an empty text give an empty list. Other columns are kept as they are, unless one has the
    name `out`: the ids then take its place. An empty table gives an empty table. Repeated rows stay
    repeated. Strings that spell a special token are encoded as ordinary text.
    """
    path = path or tokenizer_path()
    kept = [c for c in docs.columns if c not in (text, out)]
    sent = sent_table(docs, text, path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, ids in encoded(b.column(0), sent, path):
                yield pa.RecordBatch.from_arrays([*b.slice(begin, len(ids)).columns[1:], ids], names=[*kept, out])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(text, *kept).mapInArrow(join, schema)


@cache
def pieces(path: str) -> pa.Array:
    """The bytes of every id, in order of id."""
    vocabulary = json.load(open(path, encoding="utf-8"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(0x100) if b not in plain)}
    entries = vocabulary["model"]["vocab"] | {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
    out = [b""] * (max(entries.values()) + 1)
    for piece, i in entries.items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return pa.array(out, pa.large_binary())


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """The inverse of `encode`: ids joined to the table of pieces by id, and put together by position.

    An empty list and a null give an empty text; bytes that form no character become U+FFFD.
    """
    path = path or tokenizer_path()
    kept = [c for c in encoded.columns if c not in (ids, out)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in batches:
            lists = b.column(0)
            parts = table.take(lists.flatten())
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            offsets = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
            data = bytes(parts.buffers()[2]) if len(parts) else b""
            at = offsets[ends]
            texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*kept, out])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(out, T.StringType())])
    return encoded.select(ids, *kept).mapInArrow(join, schema)
