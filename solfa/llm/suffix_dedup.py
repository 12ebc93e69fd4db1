"""Removal of repeated byte strings of LENGTH bytes, or of passages of so many words, by distributed suffix sorting.

A suffix matters for its first LENGTH bytes only, which are a few leading tokens here: hashes of runs of bytes. At each
level a window of LENGTH bytes is led by one run of `size` bytes inside it, the one with the least hash (leftmost of
equal ones), so equal windows are led alike, at the same place in them. Each leading run becomes one suffix with two
tokens: its own hash, and that of all bytes that any window led by it could hold. Sampled splitters range-partition the
suffixes by their leading tokens (and place, so that many equal ones spread over buckets); a bucket sorts by multikey
quicksort and compares neighbours:

- no other suffix has the first token: none of the windows is repeated;
- others have it, and all of them the second token too: all windows are repeated;
- else one suffix of each second token goes to the next level, where runs are longer and lead fewer windows; the
  others are repeated if they share both tokens with it.

At the last level the two tokens are the two halves of the window itself, and suffixes at the edges of buckets are
compared across boundaries. Before it, an edge only sends its suffix on to the next level.

Only tokens and places are shuffled, and texts that still have open windows (picked by a sieve of fixed size).
Equality is that of 64-bit hashes of both halves of a window. Where passages are measured in words, each word's hash
stands in the place of a byte, and the white space between words doesn't matter.

Defined results: a null text is empty; texts under LENGTH bytes keep everything; repeated rows remove each other's
windows; matches never cross rows; other columns are ignored. Rows are told apart by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import sieve
from .shared import documents, key_schema, packed, parts, text_bytes, written

LENGTH = 400
#: Bytes of the leading run at each level.
LEVELS = (200, 368, 400)
#: Bytes of text for each bucket of suffixes, at the most.
BUCKET = 1 << 28
#: Windows of one text that are in memory at once.
SEGMENT = 1 << 20
REPEATED, OPEN, EDGE, WITNESS = 1, 2, 4, 8
_MASK = np.uint64((1 << 22) - 1)
_rng = np.random.default_rng(5)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) * 2 + 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS.append(np.cumprod(powers, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Measure:
    """What a passage is measured by: its length in units, the runs that lead at each level, and whether units are words."""

    length: int
    levels: tuple[int, ...]
    words: bool = False

    @property
    def least(self) -> int:
        """Bytes of the shortest passage."""
        return 2 * self.length - 1 if self.words else self.length

    def units(self, raw: bytes) -> np.ndarray:
        if self.words:
            return np.fromiter((xxhash.xxh64_intdigest(x) for x in raw.split()), np.uint64)
        return np.frombuffer(raw, np.uint8)

    def gone(self, raw: bytes, verdicts: list) -> np.ndarray:
        """Which bytes repeated windows cover: for words, from the first of them to the last in each span."""
        own = covered(self.units(raw), verdicts, self)
        if not self.words:
            return own
        out, change = np.zeros(len(raw), bool), np.diff(own.view(np.int8), prepend=0, append=0)
        if own.any():
            ends = np.array([x.span() for x in re.finditer(rb"\S+", raw)])
            for first, last in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
                out[ends[first, 0] : ends[last - 1, 1]] = True
        return out


BYTES = Measure(LENGTH, LEVELS)
#: Passages of over 50 words, whatever their bytes.
WORDS = Measure(51, (26, 47, 51), True)


class Segment:
    """Windows of length first..last-1 of a text of n units (bytes, or hashes of words), with the units around them that
    their suffixes need."""

    def __init__(self, raw: np.ndarray, first: int, last: int, length: int) -> None:
        self.length = length
        self.first, self.count, self.n = first, last - first, len(raw)
        self.at = max(0, first - length)
        own = raw[self.at : last + 2 * length]
        values = _BYTES[own] if own.dtype == np.uint8 else own
        up, self.down = _powers(len(own) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(own)], dtype=np.uint64)])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the units from begin to end (places in the text)."""
        begin, end = begin - self.at, end - self.at
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def leads(self, size: int) -> np.ndarray:
        """Where each window's leading run is in the text."""
        width = self.length - size + 1
        if width == 1:
            return np.arange(self.first, self.first + self.count)
        m, low = self.count + width - 1, self.first - self.at
        own = _mixed((self.sums[low + size : low + size + m] - self.sums[low : low + m]) * self.down[low : low + m])
        own = (own & ~_MASK) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones is the least
        blocks = np.full(-(-m // width) * width, ~np.uint64(0))
        blocks[:m] = own
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(back[: self.count], ahead[width - 1 : width - 1 + self.count])
        return (least & _MASK).astype(np.int64) + self.first

    def tokens(self, leads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens of each leading run."""
        if size == self.length:
            half = leads + self.length // 2
            return self.hashes(leads, half), self.hashes(half, leads + self.length)
        begin, end = leads - (self.length - size), leads + self.length
        short = np.maximum(0, -begin), np.maximum(0, end - self.n)
        around = self.hashes(np.maximum(begin, 0), np.minimum(end, self.n))
        return self.hashes(leads, leads + size), _mixed(around + short[0].astype(np.uint64) * np.uint64(1000003) + short[1].astype(np.uint64) * np.uint64(2000029))


def walk(raw: np.ndarray, verdicts: list[tuple[np.ndarray, np.ndarray]], by: Measure) -> Iterator[tuple[Segment, np.ndarray, np.ndarray]]:
    """Segments of a text, and which of their windows are open and which repeated after the levels judged so far.
    verdicts: of each level, the places of leading runs, ascending, and their kinds."""
    for first in range(0, len(raw) - by.length + 1, SEGMENT):
        segment = Segment(raw, first, min(first + SEGMENT, len(raw) - by.length + 1), by.length)
        open_, repeated = np.ones(segment.count, bool), np.zeros(segment.count, bool)
        for size, (places, kinds) in zip(by.levels, verdicts):
            if not open_.any():
                break
            leads = segment.leads(size)
            kind = np.zeros(segment.count, np.int64)
            if len(places):
                at = np.minimum(np.searchsorted(places, leads), len(places) - 1)
                kind = np.where(places[at] == leads, kinds[at], 0)
            # a suffix stands for others of its tokens with all windows that it leads, whatever they were before
            repeated |= kind & REPEATED > 0
            open_ = kind & OPEN > 0
        yield segment, open_, repeated


def suffixes(raw: np.ndarray, verdicts: list, by: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and tokens of the leading runs of all open windows at the next level."""
    size, out = by.levels[len(verdicts)], []
    for segment, open_, _ in walk(raw, verdicts, by):
        leads = np.unique(segment.leads(size)[open_])
        out.append((leads, *segment.tokens(leads, size)))
    if not out:
        return (np.zeros(0, np.int64), *np.zeros((2, 0), np.uint64))
    places, first, second = (np.concatenate(x) for x in zip(*out))
    places, once = np.unique(places, return_index=True)  # a run can lead windows of two segments
    return places, first[once], second[once]


def multikey_order(*tokens: np.ndarray) -> np.ndarray:
    """Order by the tokens in turn, by multikey quicksort: a segment of rows is split in three by a pivot of its token; the
    outer parts stay at this token, the middle part goes on to the next. All open segments are split in one pass, so a
    pass costs no more than its rows, and segments of one row, or equal in all tokens, are closed."""
    table, order = np.stack(tokens), np.arange(len(tokens[0]))
    start, size, depth = (np.array([x]) for x in (0, len(order), 0))
    while True:
        going = (size > 1) & (depth < len(tokens))
        start, size, depth = start[going], size[going], depth[going]
        if not len(start):
            return order
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        own = order[at]
        key = table[np.repeat(depth, size), own]
        three = np.sort(np.stack([key[ends - size], key[ends - size + size // 2], key[ends - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        part = (key >= pivot).view(np.int8) + (key > pivot).view(np.int8)
        which = np.repeat(np.arange(len(size)) * 3, size) + part
        counts = np.bincount(which, minlength=3 * len(size))
        begins = np.cumsum(counts) - counts
        placed = np.empty_like(own)
        for i in range(3):  # rows keep their order within a part
            n = counts[i::3]
            placed[np.arange(n.sum()) + np.repeat(begins[i::3] - np.cumsum(n) + n, n)] = own[part == i]
        order[at] = placed
        start = np.repeat(start - ends + size, 3) + begins
        size, depth = counts, np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth))


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's run, and the rows in each run. new: where runs begin."""
    number = np.cumsum(new) - 1
    return number, np.bincount(number)


def judge(first: np.ndarray, second: np.ndarray, last_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one sorted bucket: rows to report and their kinds. The first and last groups may go on in other buckets."""
    n = len(first)
    start = np.concatenate([[True], first[1:] != first[:-1]])
    start_class = start | np.concatenate([[True], second[1:] != second[:-1]])
    group, sizes = _runs(start)
    class_, members = _runs(start_class)
    kind = np.where(members[class_] > 1, REPEATED, 0)
    if last_level:
        edge = start_class & ((class_ == 0) | (class_ == class_[-1]))
        kind = np.where(edge, np.where(kind > 0, kind | WITNESS, EDGE), kind)
    else:
        classes = np.bincount(group[start_class])
        goes_on = (classes[group] > 1) | (group == 0) | (group == group[-1])
        kind = np.where(start_class & goes_on, kind | OPEN, kind)
    rows = np.flatnonzero(kind)
    return rows, kind[rows]


ROWS = "k long, pos long, first long, second long"
VERDICTS = "level int, k long, pos long, kind int, first long, second long"


def _emitted(texts: DataFrame, level: int, by: Measure) -> DataFrame:
    """Suffixes of texts: k, text, and (from level 1 on) verdicts, an array of (level, pos, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                out = []
                lists = _verdict_lists(part, level)
                for k, raw, verdicts in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), lists):
                    units = by.units(raw)
                    if len(units) >= by.length:
                        places, first, second = suffixes(units, verdicts, by)
                        out.append((np.full(len(places), k), places, first.view(np.int64), second.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["k", "pos", "first", "second"])

    return texts.mapInArrow(run, ROWS)


def _verdict_lists(part: pa.RecordBatch, levels: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    if not levels:
        return [[]] * part.num_rows
    column = part.column(2)
    flat = column.flatten()
    level, pos, kind = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum([n or 0 for n in pa.compute.list_value_length(column).to_pylist()])
    out, begin = [], 0
    for end, ok in zip(ends.tolist(), valid):
        own, places, kinds = level[begin:end], pos[begin:end], kind[begin:end]
        begin, row = end, []
        for i in range(levels):
            mine = own == i
            at, inverse = np.unique(places[mine], return_inverse=True)
            # equal rows (one doc_id, one text) were judged apart: what any of them is, they are
            kinds_ = np.zeros(len(at), np.int64)
            np.bitwise_or.at(kinds_, inverse, kinds[mine])
            row.append((at, kinds_))
        out.append(row)
    return out


def _judged(rows: DataFrame, level: int, by: Measure, buckets: int = 0) -> DataFrame:
    """VERDICTS of suffixes, stored. What is not reported is not repeated. buckets: how many; 0: as Spark's settings have it."""
    last = level == len(by.levels) - 1
    number = (buckets,) if buckets else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        k, pos, first, second = (table.column(c).to_numpy() for c in ("k", "pos", "first", "second"))
        order = multikey_order(first, second)
        found, kinds = judge(first[order], second[order], last)
        own = order[found]
        edge = pa.array(kinds < EDGE)  # tokens go on for edges alone
        columns = [pa.array(np.full(len(own), level), pa.int32()), pa.array(k[own]), pa.array(pos[own]), pa.array(kinds, pa.int32())]
        columns += [pa.compute.if_else(edge, None, pa.array(x[own])) for x in (first, second)]
        yield pa.RecordBatch.from_arrays(columns, ["level", "k", "pos", "kind", "first", "second"])

    found = written(rows.repartitionByRange(*number, "first", "second", "k", "pos").mapInArrow(run, VERDICTS), "verdicts")
    if not last:
        return found
    # across boundaries: a bucket reports two suffixes at most, so few rows meet here
    edges = found.filter(F.col("kind") >= EDGE)
    twice = edges.groupBy("first", "second").count().filter("count > 1").select("first", "second")
    joined = edges.filter(F.col("kind") == EDGE).join(twice, ["first", "second"], "left_semi")
    joined = joined.select("level", "k", "pos", F.lit(REPEATED).alias("kind"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"))
    return found.filter(F.col("kind") != EDGE).unionByName(joined)


def _with_verdicts(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    lists = verdicts.groupBy("k").agg(F.collect_list(F.struct("level", "pos", "kind")).alias("verdicts"))
    return docs.join(lists, "k", how)


def remove_repeats(docs: DataFrame, by: Measure = BYTES) -> DataFrame:
    """docs without passages of by.length units that repeat: kept (binary: the bytes that stay), n_bytes, n_removed and n_spans in place of text (and of columns
    that had those names)."""
    k = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    own = packed(docs, "text", "kept", "n_bytes", "n_removed", "n_spans").select("rest", "text", k.alias("k"))
    slim = own.select("k", "text").filter(F.octet_length("text") >= by.least)
    # a bucket holds its suffixes: about one for 100 bytes at first
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    needed = -(-size // BUCKET)
    buckets = needed if needed > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
    verdicts = _judged(_emitted(slim, 0, by), 0, by, buckets)
    told = sieve(verdicts, "k", F.col("k"))
    for level in range(1, len(by.levels)):
        open_ = verdicts.filter((F.col("level") == level - 1) & (F.col("kind").bitwiseAND(F.lit(OPEN)) > 0)).select("k").distinct()
        texts = _with_verdicts(slim.filter(told), verdicts.join(open_, "k", "left_semi"), "inner").select("k", "text", "verdicts")
        verdicts = verdicts.unionByName(_judged(_emitted(texts, level, by), level, by, buckets))
    repeated = verdicts.filter(F.col("kind").bitwiseAND(F.lit(REPEATED | OPEN)) > 0)
    hit = F.coalesce(told, F.lit(False)) & (F.octet_length("text") >= by.least)
    touched = _with_verdicts(own.filter(hit), repeated, "left").select("k", "text", "verdicts", "rest")
    schema = key_schema(own, ("rest",)) + ", kept binary, n_bytes long, n_removed long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                rows = []
                for raw, lists in zip(text_bytes(part.column(1)), _verdict_lists(part, len(by.levels))):
                    gone = by.gone(raw, lists)
                    spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                    rows.append((np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(3), *columns], ["rest", "kept", "n_bytes", "n_removed", "n_spans"])

    zero = F.lit(0).cast("long")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rest = own.filter(~F.coalesce(hit, F.lit(False))).select("rest", raw.alias("kept"), F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"))
    return touched.mapInArrow(run, schema).unionByName(rest).select("rest.*", "kept", "n_bytes", "n_removed", "n_spans")


def kept_text(kept: Column) -> Column:
    """The bytes that stay as text, without the characters of which a part was removed."""
    text = kept.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))


def covered(raw: np.ndarray, verdicts: list, by: Measure) -> np.ndarray:
    """Which units a repeated window covers."""
    change = np.zeros(len(raw) + 1, np.int32)
    for segment, _, repeated in walk(raw, verdicts, by):
        at = segment.first + np.flatnonzero(repeated)
        change[at] += 1
        change[at + by.length] -= 1
    return np.cumsum(change[:-1]) > 0


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, the digest of what stays, and that as text."""
    done = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept_text(F.col("kept")).alias("text"))
