"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks.

A pre-token is a linked list of byte runs. Each rank has a bucket of list positions whose pair merges to that
rank; a bitmap over ranks (words of 64 bits, and words over those words) gives the next rank by find-first-set.
Entries whose pair has changed since are stale and skipped. The cost of a pre-token of n bytes is
O(n log n), however long it is, so one long run of letters can't stall a task.

Defined results: a null or empty text has no ids; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, key_schema, parts

#: Pre-tokens of up to MEMO_CHARS kept with their ids in each Python worker, in two generations of MEMO_ENTRIES.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 64


class RankQueue:
    """Buckets of positions by rank under a bitmap of two levels: words of 64 ranks, and one word over all words."""

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def put(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        had = self.words.get(word, 0)
        if not had:
            self.top |= 1 << word
        self.words[word] = had | 1 << (rank & 63)

    def take(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank, removed."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        lowest = bits & -bits
        rank = word << 6 | lowest.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits ^ lowest
        if bits == lowest:
            self.top = top ^ 1 << word
        return rank, bucket[0]


class ByteBpe:
    """Encoder and decoder for a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.table = {rank: token for token, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue, wanted = RankQueue(), [-1] * n
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                wanted[i] = rank
                queue.put(rank, i)
        while (found := queue.take()) is not None:
            rank, i = found
            if wanted[i] != rank:
                continue
            j = after[i]
            ends[i], after[i], wanted[j] = ends[j], after[j], -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a < 0:
                    continue
                b = after[a]
                new = ranks.get(piece[a : ends[b]]) if b < n else None
                if new is None:
                    wanted[a] = -1
                elif wanted[a] != new or a == i:
                    wanted[a] = new
                    queue.put(new, a)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for piece in self.words(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    found = self.merge(piece.encode())
                    ids = struct.pack(f"<{len(found)}I", *found)
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        self.older = memo
                        memo = self.memo = {}
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe.from_file(path, pattern)
    return _CODERS[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of each row's text."""
    schema = key_schema(df, keys) + ", ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for part in parts(batch, len(keys)):
                ids = [own.encode(x or "") for x in part.column(len(keys)).to_pylist()]
                back = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*keys, "ids", "decoded"])

    return df.select(*keys, text).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids and decoded bytes of every document."""
    import public_tokenizers as vocabulary
    from pyspark.sql import functions as F

    coded = encode_column(documents(spark, sf_dir), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
