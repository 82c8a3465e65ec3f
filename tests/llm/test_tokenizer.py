import os

import pytest
from pyspark.sql import functions as F

from codeloom.llm import packing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")

TEXTS = [None, "", " ", "\n\n  x\n", "Hello, world! It's 1904.", "<|endoftext|> is text", "größer ſs 日本語 🙂\u200b", "a" * 50000, "x y " * 20000, "\x00\x1c\x85\u2028", "same same same", "same same same"]


def _frame(spark):
    return spark.createDataFrame([(n, t, "clash", 1) for n, t in enumerate(TEXTS)], "doc_id bigint, text string, words string, block int")


def test_ids_are_those_of_the_tokenizer(spark):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(tokenizer.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = tokenizer.encode_corpus(_frame(spark).repartition(3), F.col("doc_id"), F.col("text")).collect()
    got = {x["doc_id"]: x["ids"] for x in out}
    assert len(out) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        assert got[n] == ([] if not text else t.encode(text, add_special_tokens=False).ids), text


def test_small_blocks_and_long_texts_give_the_same(spark, monkeypatch):
    from pyspark import TaskContext  # noqa: F401

    import pyarrow as pa

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 7

    monkeypatch.setattr("pyspark.TaskContext", Here)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": TEXTS})
    want = list(tokenizer._blocks(iter([batch])))
    monkeypatch.setattr(tokenizer, "BLOCK_CHARS", 10)
    monkeypatch.setattr(tokenizer, "LONG_CHARS", 100)
    small = list(tokenizer._blocks(iter([batch])))
    assert len(want) == 1 and len(small) > 3
    assert [i for b in small for i in b["doc_ids"][0].as_py()] == list(range(len(TEXTS)))
    assert set(want[0]["words"][0].as_py()) == {w for b in small for w in b["words"][0].as_py()}


def test_round_trip_and_counts(spark):
    df = _frame(spark)
    enc = tokenizer.encode_corpus(df, F.col("doc_id"), F.col("text"))
    back = {x["doc_id"]: x["text"] for x in tokenizer.decode_corpus(enc).collect()}
    assert back == {n: t or "" for n, t in enumerate(TEXTS)}
    sizes = {x["doc_id"]: x["n_tokens"] for x in tokenizer.count_tokens(df, F.col("doc_id"), F.col("text")).collect()}
    assert sizes == {x["doc_id"]: len(x["ids"]) for x in enc.collect()}
    assert tokenizer.encode_corpus(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
    none = df.filter("doc_id < 2")
    assert [x["ids"] for x in tokenizer.encode_corpus(none, F.col("doc_id"), F.col("text")).collect()] == [[], []]
    assert packing.pack(tokenizer.count_tokens(df, F.col("doc_id"), F.col("text")), 2048).count() > len(TEXTS)


def test_another_vocabulary(spark):
    other = os.path.join(os.path.dirname(tokenizer.VOCABULARY), "byte_bpe_multi_50k.tiktoken")
    enc = tokenizer.encode_corpus(_frame(spark), F.col("doc_id"), F.col("text"), other)
    got = {x["doc_id"]: x["ids"] for x in enc.collect()}
    assert got == {n: tokenizer.encoder(other).encode_ordinary(t or "") for n, t in enumerate(TEXTS)}
    assert {x["doc_id"]: x["text"] for x in tokenizer.decode_corpus(enc, other).collect()} == {n: t or "" for n, t in enumerate(TEXTS)}
