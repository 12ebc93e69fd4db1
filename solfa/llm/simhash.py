"""SimHash near-duplicates: fingerprints linked at a few differing bits by a Gray-order hierarchical index.

Distinct fingerprints only are compared, so copies cost nothing. Two fingerprints within DISTANCE bits agree on at
least one of DISTANCE + 1 blocks of bits, so each is dealt to one bucket a block; a bucket of over BUCKET is dealt
anew by blocks of its bits that are still free, until all are small (distinct fingerprints of one bucket differ in
their free bits, which shrink by a quarter each time). A task sorts its buckets by Gray rank, factors the bits that
neighbours share into nodes of FAN children level by level, and searches every fingerprint from the root down,
adding the differences in each node's own bits and dropping the whole group beyond DISTANCE. Only a spanning forest of a
task's links goes on, to connected components over the smallest doc_id of each fingerprint.

Defined results: a null, empty or wordless text has fingerprint zero, linked like any other; repeated rows share a
component; an empty table gives no rows; a null doc_id never names a component while its fingerprint has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, key_schema, parts, text_bytes, written

SHINGLE, SEED, DISTANCE = 3, 42, 3
BUCKET, FAN, CHUNK = 2048, 8, 1 << 20


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the shingles' hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hash64, n, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    values = np.fromiter((hash64(s, SEED) for s in shingles), np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        n += len(part)
    return int((2 * ones > n) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), width: int = SHINGLE) -> DataFrame:
    """keys and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(keys)):
                values = np.array([fingerprint(x, width) for x in text_bytes(part.column(len(keys)))], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(values.view(np.int64))], [*keys, "fp"])

    return df.select(*keys, text).mapInArrow(run, key_schema(df, keys) + ", fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over codes that are sorted by bucket and, within one, by Gray rank: one tree a bucket."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray) -> None:
        """bucket: a number for each code, not falling."""
        self.codes, self.levels = codes, []  # from the leaves up: (first child, child count, pattern, mask)
        every, none, owner = codes, codes, bucket
        while True:
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            begin = np.flatnonzero(new)
            place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            starts = np.flatnonzero(place % FAN == 0)
            every, none = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(none, starts)
            owner = owner[starts]
            self.levels.append((starts, np.diff(np.append(starts, len(place))), every, ~(every ^ none)))
            if len(np.unique(owner)) == len(owner):
                break
        self.root = np.searchsorted(owner, bucket)

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of codes of one bucket within distance bits, the lesser place first."""
        size = len(self.codes)
        todo = [(len(self.levels) - 1, np.arange(size), self.root, np.zeros(size, np.int64), np.zeros(size, np.uint64))]
        while todo:
            level, query, node, sum_, known = todo.pop()
            starts, counts, pattern, mask = self.levels[level]
            # a node's own bits are those that its codes share and its parent's don't
            sum_ = sum_ + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node] & ~known)
            keep = sum_ <= distance
            query, node, sum_ = query[keep], node[keep], sum_[keep]
            known, many = mask[node], counts[node]
            ends = np.cumsum(many)
            if len(query) > 1 and ends[-1] > CHUNK:
                cut = max(1, int(np.searchsorted(ends, ends[-1] // 2)))
                for part in (slice(0, cut), slice(cut, None)):
                    before = sum_[part] - np.bitwise_count((self.codes[query[part]] ^ pattern[node[part]]) & mask[node[part]])
                    todo.append((level, query[part], node[part], before, np.zeros(len(before), np.uint64)))
                continue
            if not len(query):
                continue
            child = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(starts[node], many)
            query, sum_, known = np.repeat(query, many), np.repeat(sum_, many), np.repeat(known, many)
            if level:
                todo.append((level - 1, query, child, sum_, known))
                continue
            later = child > query
            query, child, sum_, known = query[later], child[later], sum_[later], known[later]
            near = sum_ + np.bitwise_count((self.codes[query] ^ self.codes[child]) & ~known) <= distance
            yield query[near], child[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that each of n places reaches."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (root != (up := root[root])).any():
                root = up
    return root


def _blocks(used: int, count: int) -> list[int]:
    """Masks used | block for count blocks of the bits that are not in used."""
    free = [i for i in range(64) if not used >> i & 1]
    out = [used | sum(1 << i for i in free[j * len(free) // count : (j + 1) * len(free) // count]) for j in range(count)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(codes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """a, b: ids whose codes are linked through codes within distance bits of each other. codes: fp (distinct), id."""
    found, rows, masks = None, codes.withColumn("used", F.lit(0).cast("long")), [0]
    while True:
        children = {m: _blocks(m % (1 << 64), distance + 1) for m in masks}
        table = F.create_map(*(x for m, c in children.items() for x in (F.lit(m).cast("long"), F.array(*(F.lit(y).cast("long") for y in c)))))
        dealt = rows.select("fp", "id", F.explode(F.element_at(table, F.col("used"))).alias("used"))
        dealt = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("used"))).distinct()
        large = written(dealt.groupBy("used", "value").count().filter(F.col("count") > bucket).select("used", "value"), "large")
        n = large.count()
        # a bucket over the bound has over `bucket` rows, so their number is known to be small before it is sent
        large = F.broadcast(large) if n <= 100_000 else large
        small = dealt.join(large, ["used", "value"], "left_anti") if n else dealt
        new = _search(small, distance)
        found = new if found is None else found.unionByName(new)
        if not n:
            return found
        rows = written(dealt.join(large, ["used", "value"], "left_semi").select("fp", "id", "used"), "crowded")
        masks = [r["used"] for r in rows.select("used").distinct().collect()]  # at most (distance + 1) ** level


def _search(rows: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 65_536:
                table = pa.Table.from_batches(held).combine_chunks()
                used, value = (table.column(c).to_numpy() for c in ("used", "value"))
                whole = int(np.flatnonzero((used != used[-1]) | (value != value[-1]))[-1]) + 1 if ((used != used[-1]) | (value != value[-1])).any() else 0
                if whole:
                    yield from found(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                count -= whole
        if count:
            yield from found(pa.Table.from_batches(held))

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        used, value, ids = (table.column(c).to_numpy() for c in ("used", "value", "id"))
        codes = table.column("fp").to_numpy().view(np.uint64)
        bucket = np.cumsum(np.concatenate([[False], (used[1:] != used[:-1]) | (value[1:] != value[:-1])]))
        order = np.lexsort((gray_rank(codes), bucket))
        codes, ids = codes[order], ids[order]
        root = forest(len(codes), GrayIndex(codes, bucket[order]).links(distance))
        linked = root != np.arange(len(root))
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

    dealt = rows.repartition("used", "value").sortWithinPartitions("used", "value")
    return dealt.select("used", "value", "fp", "id").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    own = written(fingerprints(df.select(F.col("doc_id").cast("long").alias("doc_id"), text), text), "fingerprints")
    codes = written(own.groupBy("fp").agg(F.min("doc_id").alias("id")), "codes")
    roots = components(links(codes.filter("id is not null"), distance))
    classes = written(codes.join(roots, codes.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id")), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
