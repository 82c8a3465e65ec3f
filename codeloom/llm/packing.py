"""Filling containers of fixed capacity with documents, by reciprocal-capacity classes.

Class k holds the lengths in (C / (k + 1), C / k]; a container of class k takes k documents of that class. The room that
is then left is filled up with documents of higher classes. As lengths are whole numbers up to C, the plan of all containers
follows from how many documents have each length, at most C numbers whatever the corpus. Each document is then placed
by its length and its rank among equally long ones, independently on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import ship, written

#: Ranks are counted in sub-lists of about this many documents.
RANK_ROWS = 500_000


def plan_containers(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Segments (length, first rank, documents per container, first container), and the number of containers.

    Ranks of a length from a segment's first up to the next one's go into consecutive containers, so many into each."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if 0 < length <= capacity:
            left[length] = n
    used, segments, containers = np.zeros(capacity + 1, np.int64), [], 0
    present = [x for x in range(capacity, 0, -1) if left[x]]
    while present:
        top = present[0]
        k = capacity // top  # its class: k documents of this class fit for sure
        room, docs, takes = capacity, k, []
        for length in present:
            if docs == 0 or length * (k + 1) <= capacity:  # the class is served
                break
            n = min(docs, int(left[length]))
            takes.append([length, n])
            docs, room = docs - n, room - n * length
        lowest = capacity // (k + 1)
        for length in present:  # what is left over goes to the largest that fit
            if length > room:
                continue
            if room <= 0:
                break
            if length > lowest and docs == 0:
                continue
            free = int(left[length]) - sum(n for x, n in takes if x == length)
            n = min(room // length, free)
            if n > 0:
                takes.append([length, n])
                room -= n * length
        need: dict[int, int] = {}
        for length, n in takes:
            need[length] = need.get(length, 0) + n
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            segments.append((x, int(used[x]), n, containers))
            used[x] += n * times
            left[x] -= n * times
        containers += times
        present = [x for x in present if left[x]]
    if counts.get(0):
        segments.append((0, 0, -(-counts[0] // max(containers, 1)), 0))
        containers = max(containers, 1)
    return segments, containers


def _place(segments: list[tuple[int, int, int, int]]):
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by length, then by first rank; a structured key keeps both exact
        starts: dict[int, tuple[int, int]] = {}
        lengths, first = np.unique(table[:, 0], return_index=True)
        for x, lo, hi in zip(lengths, first, np.append(first[1:], len(table)), strict=True):
            starts[int(x)] = (int(lo), int(hi))
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            seg = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = starts[int(x)]
                own = length == x
                seg[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            container = table[seg, 3] + (rank - table[seg, 1]) // table[seg, 2]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"], pa.array(container)], names=["doc_id", "piece", "start", "length", "container_id"])

    return run


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, container_id for sizes of doc_id, n_tokens.

    A document of at most capacity tokens is one piece; a longer one is cut into full pieces and a rest, each piece its own row.
    Documents of no tokens lie in a container as well and take no room. Null sizes are 0. Every row of sizes comes out;
    rows with equal doc_id are placed one by one. An empty input gives no rows. Other columns are ignored."""
    spark = sizes.sparkSession
    ship(spark)
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("bigint") - 1, F.lit(0))
    pieces = sizes.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("length")
    )
    counts = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}
    segments, _ = plan_containers(counts, capacity)
    lists = max(8, -(-sum(counts.values()) // RANK_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lists)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    # the offsets grow with the corpus, so they are not broadcast; the window has left the rows as this join needs them
    ranked = salted.withColumn("own", own).join(offset.hint("merge"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("own") + F.col("offset")).cast("bigint").alias("rank"))
    return ranked.mapInArrow(_place(segments), "doc_id bigint, piece bigint, start bigint, length bigint, container_id bigint")


def pack_documents(sizes: DataFrame, capacity: int) -> DataFrame:
    """pack over sizes that are costly to compute: they are written once."""
    return pack(written(sizes, "document-sizes"), capacity)
