"""Encoding and decoding of a whole corpus with a public byte-level BPE tokenizer.

Pre-tokens repeat, so each distinct one is encoded once for the whole corpus:

1. Each block of documents explodes its texts into pre-tokens, and keeps them as positions in the block's own word list.
   The blocks are written to the shared folder once.
2. The words of all blocks are shuffled by word; each distinct word is encoded once, and its ids are joined back.
3. Ids and positions of a block meet by its number, and the texts are put together again.

What is shuffled is one row for each distinct word of a block, and the packed positions, rather than one row for each pre-token.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship, spread, written

#: Where the driver finds the vocabulary; workers get it with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits text before its merges; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block is closed after so many characters; one document is never cut.
BLOCK_CHARS = 8 << 20
#: Texts longer than this are split one match at a time, not into one list.
LONG_CHARS = 4 << 20
#: A worker forgets its words beyond this many.
CACHE_WORDS = 1 << 20

BLOCKS = "block bigint, doc_ids array<bigint>, ends array<bigint>, codes binary, words array<string>"


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """Sends a vocabulary file along with the application's jobs; the name it has on every worker."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _sent:
        spark.sparkContext.addFile(vocabulary)
        _sent.add(key)
    return os.path.basename(vocabulary)


_sent: set[tuple[str, str]] = set()


def _here(name: str) -> str:
    """Where a worker has a shipped file."""
    return SparkFiles.get(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def encode_word(path: str, word: str) -> list[int]:
    return encoder(path).encode_ordinary(word)


class WordLengths(dict):
    """Number of tokens of a word, remembered."""

    def __init__(self, path: str):
        self.path = path

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = self[word] = len(encode_word(self.path, word))
        return n


def words_of(text: str) -> Iterator[str]:
    if len(text) > LONG_CHARS:
        return (m.group() for m in splitter().finditer(text))
    return iter(splitter().findall(text))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32  # task number above, block number of the task below
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string()))])
    n = 0

    def start():
        v = defaultdict()
        v.default_factory = v.__len__  # an unseen word gets the next number
        return [], [], [], v, 0, 0

    def close(ids, ends, parts, vocabulary):
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        small = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
        row = {"block": [first + n], "doc_ids": [ids], "ends": [ends], "codes": [codes.astype(small).tobytes()], "words": [list(vocabulary)]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    ids, ends, parts, vocabulary, chars, at = start()
    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            text = text.as_py()
            if text:
                codes = np.fromiter(map(vocabulary.__getitem__, words_of(text)), np.uint32)
                parts.append(codes)
                at += len(codes)
                chars += len(text)
            ids.append(doc_id)
            ends.append(at)
            if chars >= BLOCK_CHARS or len(ids) >= 1 << 16:
                yield close(ids, ends, parts, vocabulary)
                n += 1
                ids, ends, parts, vocabulary, chars, at = start()
    if ids:
        yield close(ids, ends, parts, vocabulary)


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_here(name))
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b["word"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["word"], pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and the length of each list."""
    a = pa.concat_arrays(lists.chunks)
    return a.flatten().to_numpy(zero_copy_only=False), a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces values[start : start + length] one after another."""
    upto = np.cumsum(lengths)
    return values[np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    doc_ids, ends = left["doc_ids"].chunk(0)[0].values, left["ends"].chunk(0)[0].values.to_numpy()
    raw = left["codes"].chunk(0)[0].as_buffer()
    if right.num_rows:
        values, lengths = _flat(right["ids"])
        starts, where = np.cumsum(lengths) - lengths, np.argsort(right["code"].to_numpy())
        starts, lengths = starts[where], lengths[where]
        codes = np.frombuffer(raw, np.uint16 if right.num_rows <= 1 << 16 else np.uint32)
        flat, upto = gather(values, starts[codes], lengths[codes]), np.append(0, np.cumsum(lengths[codes]))
        offsets = np.append(0, upto[ends])
    else:
        flat, offsets = np.zeros(0, np.int32), np.zeros(len(ends) + 1, np.int64)
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    return pa.Table.from_arrays([doc_ids, ids], names=["doc_id", "ids"])


def encode_corpus(docs: DataFrame, doc_id: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) of every row, in the public tokenizer's ids without special tokens; the strings of special tokens
    are ordinary text. Null and empty texts give an empty list. Repeated rows come out as often as they came in. Texts
    of any length are encoded whole. An empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    blocks = written(spread(docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))).mapInArrow(_blocks, BLOCKS), "token-blocks")
    words = blocks.select(F.col("block").alias("of_block"), F.posexplode("words").alias("code", "word"))
    known = words.select("word").distinct().mapInArrow(_encode(shipped(spark, vocabulary)), "word string, ids array<int>")
    ids = words.join(known, "word").select("of_block", "code", "ids")
    held = blocks.select("block", "doc_ids", "ends", "codes")
    return held.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in ranks(_here(name)).items()}
        size = max(by_id) + 1
        pieces = [by_id.get(i, b"") for i in range(size)]
        lengths = np.array([len(x) for x in pieces], np.int64)
        starts, values = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(pieces), np.uint8)
        for b in batches:
            a = b["ids"]
            flat, n = a.flatten().to_numpy(zero_copy_only=False), a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(lengths[flat]))
            data, ends = gather(values, starts[flat], lengths[flat]).tobytes(), upto[np.append(0, np.cumsum(n))]
            texts = [data[ends[k] : ends[k + 1]].decode(errors="replace") for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids: each id is looked up in the table of token bytes, which has a fixed size. An empty or null
    list gives the empty text."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shipped(encoded.sparkSession, vocabulary)), "doc_id bigint, text string")


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = WordLengths(_here(name))
        get = lengths.__getitem__
        for b in batches:
            n = [sum(map(get, words_of(t))) if (t := x.as_py()) else 0 for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, doc_id: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every row, in one pass and without a shuffle; null and empty texts have 0."""
    ship(docs.sparkSession)
    return spread(docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))).mapInArrow(_count(shipped(docs.sparkSession, vocabulary)), "doc_id bigint, n_tokens bigint")
