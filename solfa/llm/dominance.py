"""Packing whole documents into few sequences: dominance reduction, then best fit.

Documents above the capacity are cut into full pieces and one shorter first piece; full pieces are sequences of their own.
All other pieces of a length are alike, so the instance is one number for each length below the capacity, however many
documents there are. It is reduced by sets of up to three pieces that dominate every other set with their largest
piece (anything else beside that piece could be swapped for the set without a sequence more), all copies at once; what no
such set settles is packed by best fit, lengths falling. The result, kinds of sequences and how often each occurs, is as
bounded as the instance. Every piece has a place among those of its length: its place in its task plus how many earlier tasks
hold. The place says which sequence and offset it gets, so no task sees more than its own pieces.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are packed each by itself; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, parts, written
from .tokenizing import spaced_ids

CAPACITY, END_ID = 1024, 2
#: Bytes of text that are encoded together.
BATCH = 8 << 20
#: Sequences of one full piece are numbered from here: 2^62, the task times 2^36, the place in the task.
FULL = 1 << 62

#: A kind of sequence: its (length, copies), and how many sequences are of the kind.
Kind = tuple[tuple[tuple[int, int], ...], int]


def _last(free: np.ndarray, most: int) -> int:
    """The largest length with free copies, up to most; 0 if there is none."""
    found = np.flatnonzero(free[: max(most, 0) + 1])
    return int(found[-1]) if len(found) else 0


def dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other set with j, if sets of up to three have one."""
    room, free = capacity - j, counts.copy()
    free[j] -= 1
    k = _last(free, room)
    if not k:
        return (j,)
    if k == room:
        return (j, k)
    small = []
    for s in np.flatnonzero(free[: room + 1])[:3].tolist():
        small += [s] * min(3, int(free[s]))
    if len(small) < 2 or small[0] + small[1] > room:
        return (j, k)
    if len(small) > 2 and sum(small[:3]) <= room:
        return None  # three more may fit
    free[k] -= 1
    b = _last(free, room - k)
    free[k] += 1
    lengths = np.flatnonzero(free[: room + 1])
    for y in lengths[lengths > b].tolist():  # pairs that neither member of (k, b) covers one by one must fit in k's place
        free[y] -= 1
        x = _last(free, room - y)
        free[y] += 1
        if x >= y and x + y > k:
            return None
    return (j, k, b) if b else (j, k)


def reduced(counts: np.ndarray, capacity: int) -> tuple[list[Kind], np.ndarray]:
    """Kinds that dominance settles, and the counts that it leaves. counts: by length, up to the capacity."""
    counts, kinds, going = counts.copy(), [], True
    while going:
        going = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (own := dominating(counts, j, capacity)):
                members = Counter(own)
                m = min(int(counts[s]) // q for s, q in members.items())
                for s, q in members.items():
                    counts[s] -= q * m
                kinds.append((tuple(members.items()), m))
                going = True
    return kinds, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Kinds by best fit, lengths falling: each piece goes where it leaves the least room."""
    spare: list[list[Kind]] = [[] for _ in range(capacity + 1)]
    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            room = next((r for r in range(s, capacity + 1) if spare[r]), capacity)
            own, m = spare[room].pop() if spare[room] else ((), left)
            each = room // s
            full = min(m, left // each)
            if full:
                spare[room - each * s].append(((*own, (s, each)), full))
                left -= full * each
            if full < m:
                some = 1 if left else 0
                if some:
                    spare[room - left * s].append(((*own, (s, left)), 1))
                    left = 0
                if own and m > full + some:
                    spare[room].append((own, m - full - some))
    return [kind for kinds in spare for kind in kinds]


def places(kinds: list[Kind]) -> np.ndarray:
    """Rows (length, first place, copies, offset, first sequence), by length and place: the pieces of a length from that
    place on go into sequences from that one on, so many copies in each, from that offset on."""
    rows, taken, sequence = [], Counter(), 0
    for members, m in kinds:
        offset = 0
        for s, q in members:
            rows.append((s, taken[s], q, offset, sequence))
            taken[s] += q * m
            offset += q * s
        sequence += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with checksums of their ids, the task that made them and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = spaced_ids(path), np.array([end_id], "<u4").tobytes()
        seen, number = [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            for part in parts(batch, 1, BATCH):
                rows = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), own.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), number, seen[length]))
                        seen[length] += 1
                        start, length = start + length, capacity
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                kinds = [pa.int32() if c in ("piece", "part") else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, stored pieces, with sequence_id and offset."""
    full = F.col("length") == capacity
    number = F.lit(FULL) + F.col("part") * F.lit(1 << 36) + F.col("place")
    whole = cut.filter(full).withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})
    rest = cut.filter(~full)
    held = written(rest.groupBy("part", "length").agg(F.count(F.lit(1)).alias("held")), "held")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("held")).collect():  # fewer rows than the capacity
        counts[length] = n
    kinds, left = reduced(counts, capacity)
    table = places(kinds + best_fit(left, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    placed = rest.join(before, ["part", "length"]).withColumn("place", F.col("place") + F.col("before")).select(*cut.columns)
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place"))
            row = np.empty(len(length), np.int64)
            for s in np.unique(length).tolist():
                own = length == s
                row[own] = firsts[s] + np.searchsorted(table[firsts[s] : firsts[s + 1], 1], place[own], "right") - 1
            _, first, copies, offset, sequence = table[row].T
            bin_, slot = np.divmod(place - first, copies)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence + bin_), pa.array(offset + slot * length)], names)

    kinds_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    return whole.unionByName(placed.mapInArrow(run, kinds_of)).drop("part", "place")


def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets."""
    import public_tokenizers as vocabulary

    return pack(written(pieces(documents(spark, sf_dir), vocabulary.path("byte_bpe_50k.json")), "pieces"))
