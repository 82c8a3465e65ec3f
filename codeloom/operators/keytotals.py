"""Totals per key when a few keys hold most of the rows.

1. Rows are reduced to one per pair of keys (and copies of a row to one) with map-side combines, over exchanges whose hash
   holds both keys, so no key pulls its rows together.
2. Each of the equal splits that result encodes its keys as small integers and adds its rows into dense arrays
   (bincount / scatter-add), once per key field. A key leaves a split as one cell, however many rows it had.
3. The cells are cut into blocks by the hash of the key; the blocks of all splits are summed into one dense array each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import ship

#: A split is flushed after so many pairs, which bounds the arrays in a worker.
FLUSH_PAIRS = 1 << 20
#: Blocks are cut so that the arrays of one hold about so many keys at most, however many keys there are.
BLOCK_KEYS = 1 << 20
PARTIAL = "field int, block int, keys array<string>, n_rows array<bigint>, n_partners array<bigint>, total array<bigint>"
TOTALS = "field int, key_value string, n_rows bigint, n_partners bigint, total bigint"


def _block_of(keys: pa.Array, blocks: int) -> np.ndarray:
    h = pd.util.hash_array(np.array(keys.fill_null("").to_pylist(), dtype=object), categorize=False)
    return (h % np.uint64(blocks)).astype(np.int64)


def _scatter(keys: pa.Array | pa.ChunkedArray, columns: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    """Dense codes for the keys, and the sum of every column over each code."""
    coded = keys.dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = pa.concat_arrays(coded.chunks)
    codes, out = coded.indices.to_numpy(zero_copy_only=False), []
    for c in columns:
        acc = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.add.at(acc, codes, c)  # exact in 64 bits, which float bincount weights are not
        out.append(acc)
    return coded.dictionary, out


def _partial(blocks: int):
    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        n, total = t["n_rows"].to_numpy(), t["total"].to_numpy()
        for field, name in enumerate(("key_a", "key_b")):
            keys, (a, b, c) = _scatter(t[name], [n, np.ones(len(n), dtype=np.int64), total])
            block = _block_of(keys, blocks)
            order = np.argsort(block, kind="stable")
            at, first = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(order)).cast(pa.string()), pa.array(a[order]), pa.array(b[order]), pa.array(c[order]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), field), pa.int32()), pa.array(at, pa.int32()), *lists], names=["field", "block", "keys", "n_rows", "n_partners", "total"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= FLUSH_PAIRS:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _reduce(t: pa.Table) -> pa.Table:
    flat = [pa.concat_arrays([x.flatten() for x in t[c].chunks]) for c in ("keys", "n_rows", "n_partners", "total")]
    keys, sums = _scatter(flat[0], [x.to_numpy(zero_copy_only=False) for x in flat[1:]])
    field = pa.array(np.full(len(keys), t["field"][0].as_py()), pa.int32())
    return pa.Table.from_arrays([field, keys.cast(pa.string()), *(pa.array(x) for x in sums)], names=["field", "key_value", "n_rows", "n_partners", "total"])


def key_totals(rows: DataFrame, row_id: Column, key_a: Column, key_b: Column, weight: Column, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """For each key of field 0 (key_a) and field 1 (key_b): rows, distinct keys of the other field, and summed weight.

    Rows with equal row_id, keys and weight are one row delivered again and count once. A null weight is 0. A null key
    is a group of its own (key_value null), so that the rows of a field always add up. An empty input gives no rows. Other
    columns of the input are ignored. Totals are exact 64-bit integers."""
    spark = rows.sparkSession
    ship(spark)
    pairs = (
        rows.select(row_id.alias("row_id"), key_a.alias("key_a"), key_b.alias("key_b"), F.coalesce(weight.cast("bigint"), F.lit(0)).alias("weight"))
        .distinct()
        .groupBy("key_a", "key_b")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("total"))
    )
    # a row has one key of each field, so this many blocks hold BLOCK_KEYS distinct keys or fewer on average
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows.count() // block_keys))
    return pairs.mapInArrow(_partial(blocks), PARTIAL).groupBy("field", "block").applyInArrow(_reduce, TOTALS)


def heavy_keys(totals: DataFrame, share_percent: int) -> DataFrame:
    """The keys (null left out) with more than share_percent of their field's rows; there are fewer than 100 / share_percent
    of them. totals must be cheap to read twice, such as a written table."""
    sums = {x["field"]: x["n"] for x in totals.groupBy("field").agg(F.sum("n_rows").alias("n")).collect()}
    least = F.lit(None).cast("bigint")
    for field, n in sums.items():
        least = F.when(F.col("field") == field, F.lit(n)).otherwise(least)
    return totals.filter(F.col("key_value").isNotNull() & (F.col("n_rows") * 100 > least * share_percent))
