"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and stored in blocks of up to BLOCK rows, sorted by id: for each component, a bitmap over
the block's rows for each bit of its two's complement. A query's scores are summed slice by slice: each signed
digit of a query component adds the component's slices, shifted, by carry-save bitmap arithmetic. The k best rows
come from the most significant score slice downward; rows on the boundary tie exactly and go by id, and the scores
of the rows found are the exact integer products.

Queries are a share of the rows, so neither side is broadcast. Candidates are dealt to blocks and queries to parts; each pair
of a block and a part is a unit, whose rows travel one by one, candidates first: a task holds the candidates of one block, and
queries pass by it. What travels is a copy of a candidate for each part and of a query for each block. A unit yields at most k
rows a query, and these are ranked by query.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component take no part; only vectors
of one length are compared (a query meets candidates of its own length); rows that repeat an id are candidates each,
as queries the least vector stands for the id; a query never meets rows of its own id; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import rows_needed, written

#: Candidates of a block, queries of a part at most, and the most tasks that units are dealt to.
BLOCK, QUERIES, TASKS, SCALE = 16_384, 4096, 4096, 256
#: Quantised components beyond this are refused: products of 64 bits must hold their sum.
BOUND = 1 << 24


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v (array of long) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(whole).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def signed_digits(n: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form of n."""
    out, shift = [], 0
    while n:
        if n & 1:
            sign = 2 - (n & 3)
            out.append((shift, sign))
            n -= sign
        n >>= 1
        shift += 1
    return out


class SlicedBlock:
    """Bitmaps over rows for each bit of each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        rows, dims = vectors.shape
        top = int(np.abs(vectors).max(initial=1))
        if top > BOUND:
            raise ValueError("components are too large to index exactly")
        self.bits = top.bit_length() + 1
        self.words = -(-rows // 64)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:rows] = 1
        self.valid = self._map(valid[None])[0]
        padded = np.zeros((self.words * 64, dims), np.int64)
        padded[:rows] = vectors
        self.slices = np.stack([self._map((padded.T >> b & 1).astype(np.uint8)) for b in range(self.bits)], 1)

    def _map(self, bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Slices of the score plus a bias that makes it unsigned, least significant first."""
        reach = max(1, int(np.abs(query).sum()) << (self.bits - 1))
        width = reach.bit_length() + 2
        total, carry = np.zeros((2, width, self.words), np.uint64)
        x, y = np.empty((2, width, self.words), np.uint64)
        bias = 1 << (width - 1)
        term = np.empty((width, self.words), np.uint64)
        for d in np.flatnonzero(query).tolist():
            for shift, sign in signed_digits(int(query[d])):
                term[:shift] = 0
                term[shift : shift + self.bits] = self.slices[d]
                term[shift + self.bits :] = self.slices[d, -1]  # the sign goes on
                if sign < 0:  # minus: all bits turned, and one more, which the bias takes up
                    np.invert(term, out=term)
                    bias += 1
                np.bitwise_xor(total, carry, out=x)
                np.bitwise_and(total, carry, out=y)
                np.bitwise_xor(x, term, out=total)
                np.bitwise_and(x, term, out=x)
                np.bitwise_or(x, y, out=x)
                carry[1:] = x[:-1]  # the top carry falls out of the two's complement
                carry[0] = 0
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        constant = np.array([ones if bias >> b & 1 else np.uint64(0) for b in range(width)])[:, None]
        np.bitwise_xor(total, carry, out=x)
        np.bitwise_and(total, carry, out=y)
        out = x ^ constant
        up = (x & constant) | y
        ripple = np.zeros(self.words, np.uint64)
        shifted = np.concatenate([np.zeros((1, self.words), np.uint64), up[:-1]])
        for b in range(width):
            a, c = out[b], shifted[b]
            one = a ^ c
            next_ = (a & c) | (ripple & one)
            out[b] = one ^ ripple
            ripple = next_
        return out

    def best(self, query: np.ndarray, k: int, without: int | None) -> np.ndarray:
        """Places of the k best rows, ties to the lesser id."""
        valid = self.valid
        if without is not None:
            own = np.arange(*np.searchsorted(self.ids, [without, without + 1]))
            if len(own):
                valid = valid.copy()
                np.bitwise_and.at(valid, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        sure, maybe = np.zeros_like(valid), valid
        for bits in self.scores(query)[::-1]:
            high = maybe & bits
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                maybe = high
            else:
                sure, maybe = sure | high, maybe & ~bits
                if n == k:
                    maybe = np.zeros_like(maybe)
                    break
        found = self._places(sure)
        return np.concatenate([found, self._places(maybe)[: k - len(found)]])

    def _places(self, bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return at[row] * 64 + bit


def units(vectors: DataFrame, queries: DataFrame, block: int, query_block: int) -> DataFrame:
    """unit, asks (whether the row is a query), id, v: each block of candidates once for each part of the queries, and each query
    once for each block. All rows of a unit are in one partition, candidates first."""
    blocks = rows_needed(vectors, block)  # dealt evenly and stored, so that a row keeps its block
    own = written(vectors.select("id", "v").repartition(blocks).withColumn("_block", F.spark_partition_id().cast("long")), "blocks")
    asked = written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, cores = rows_needed(asked, 1), vectors.sparkSession.sparkContext.defaultParallelism
    parts = min(n, max(-(-n // query_block), -(-2 * cores // blocks)))  # with few blocks, parts enough for all cores
    each = lambda n, number: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), number)).alias("unit")
    held = own.select(each(parts, lambda part: F.col("_block") * parts + part), F.lit(False).alias("asks"), "id", "v")
    passing = asked.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))).select(each(blocks, lambda b: b * parts + F.col("_part")), F.lit(True).alias("asks"), "id", "v")
    met = held.unionByName(passing)
    tasks = min(TASKS, blocks * parts)
    return met.repartitionById(tasks, (F.col("unit") % tasks).cast("int")).sortWithinPartitions("unit", "asks")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: id, v. queries: the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, built = None, {}, {}  # by length of vectors: rows not built yet, and blocks
        for batch in batches:
            number, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lengths, flat = np.diff(batch.column(3).offsets.to_numpy()), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if begin == end:
                    continue
                if number[begin] != unit:
                    unit, held, built = number[begin], {}, {}
                for dims in np.unique(lengths[begin:end]).tolist():
                    at = begin + np.flatnonzero(lengths[begin:end] == dims)
                    rows = flat[starts[at][:, None] + np.arange(dims)]
                    if not asks[begin]:
                        held.setdefault(dims, []).append((ids[at], rows))
                        continue
                    if dims in held:
                        own, all_rows = (np.concatenate(x) for x in zip(*held.pop(dims)))
                        order = np.argsort(own, kind="stable")
                        built[dims] = SlicedBlock(own[order], all_rows[order])
                    if dims in built:
                        index, out = built[dims], []
                        for id_, query in zip(ids[at].tolist(), rows):
                            best = index.best(query, k, id_)
                            out.append((np.full(len(best), id_), index.ids[best], index.vectors[best] @ query))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = units(vectors, queries, block, query_block).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose vec_id is divisible by 50."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
