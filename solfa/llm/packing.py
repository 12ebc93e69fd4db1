"""Packing token pieces into windows of near-equal length by Karmarkar-Karp multiway differencing.

A document's ids (and its end id) are cut at multiples of the capacity; full pieces are windows of their own.
The rest are dealt into blocks of about BLOCK pieces by a hash of their row, so no block depends on a key's
frequency, and each block is packed by itself: partial partitions with the largest spread are merged with their
sums in opposite order until one is left. The window count starts at the least that could hold the block's ids
and rises whenever a window comes out over capacity. Only lengths and checksums are shuffled, never ids.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are packed each by itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, parts, rows_needed, written
from .tokenizing import word_ids

CAPACITY, BLOCK, END_ID = 4096, 1000, 2


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The part (0 to k-1) of each size, and the sums of the parts."""
    n = len(sizes)
    queue = [(-int(size), i, np.array([size]), np.array([i])) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(queue)
    merged: list[np.ndarray] = []  # the two nodes that each node beyond the first n unites
    turn, node = n, n
    while len(queue) > 1:
        _, _, a, a_nodes = heapq.heappop(queue)
        _, _, b, b_nodes = heapq.heappop(queue)
        both = max(0, len(a) + len(b) - k)  # parts not listed are empty: only so many must share
        x, y = len(a) - both, len(b) - both
        merged.append(np.stack([a_nodes[x:], b_nodes[y:][::-1]], 1))
        sums = np.concatenate([a[:x], a[x:] + b[y:][::-1], b[:y]])
        nodes = np.concatenate([a_nodes[:x], np.arange(node, node + both), b_nodes[:y]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes, node = sums[order], nodes[order], node + both
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(queue, (-spread, turn, sums, nodes))
        turn += 1
    _, _, sums, nodes = queue[0]
    part = np.full(node, -1)
    part[nodes] = np.arange(len(nodes))
    for i, (a, b) in reversed(list(enumerate(np.concatenate(merged) if merged else [], n))):
        part[a] = part[b] = part[i]
    return part[:n], np.concatenate([sums, np.zeros(k - len(sums), sums.dtype)])


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size; none holds over capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return part
        k += 1 + k // 500


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document, with checksums of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in parts(batch, 1):
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), own.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        rows.append((doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """cut, a stored table with a column length, with sequence_id and offset."""
    rows = cut.withColumn("_row", F.monotonically_increasing_id())
    full = F.col("length") == capacity
    whole = rows.filter(full).withColumn("sequence_id", F.col("_row") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.filter(~full)
    blocks = rows_needed(rest, block)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        sizes = table.column("length").to_numpy()
        part = windows(sizes, capacity)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], part[order][1:] != part[order][:-1]])
        starts = ends - sizes[order]
        offset = np.empty_like(sizes)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        base = table.column("_block")[0].as_py() << 32
        return table.drop_columns("_block").append_column("sequence_id", pa.array(part + base, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    return whole.unionByName(dealt.groupBy("_block").applyInArrow(run, kinds)).drop("_row")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets."""
    import public_tokenizers as vocabulary

    return pack(written(pieces(documents(spark, sf_dir), vocabulary.path("word_bpe_49k.json")), "pieces"))
