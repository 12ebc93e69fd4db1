"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts of up to CHUNK characters are encoded whole. A longer one is encoded in chunks that overlap, with offsets.
Two neighbouring chunks are spliced at a white-space character inside their overlap where a boundary is proven:
no token of the vocabulary crosses it (see stable_points), neither chunk has a token over it, and both chunks have
the same tokens at the same offsets between it and the next such point. If no point of the overlap passes, the
overlap doubles, up to the whole chunk, and then the chunk itself grows, so the worst case is one whole encoding.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows give repeated results; other columns
are ignored. Special strings inside a text count as the library counts them by default.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, key_schema, parts
from .tokenizing import library

CHUNK, OVERLAP = 4_096, 128
#: White space for tokenizers' \\s; a word-end vocabulary drops it, so no token holds any.
_SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]")
#: A plain space after another character: only here does a sentencepiece piece surely begin anew.
_PIECE_SPACE = regex.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Pieces:
    """An encoded chunk as a table of ids and places."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.size = table, len(table)

    def over(self, begin: int, end: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of tokens before text[begin:end], and those over it: id, begin, end."""
        first = int(np.argmax(self.table[:, 2] > begin)) if (self.table[:, 2] > begin).any() else self.size
        return first, [tuple(t) for t in self.table[first:].tolist() if t[1] < end]


class Encoded:
    """An encoded chunk as the library holds it, which is asked for the few places that are needed."""

    def __init__(self, own, at: int) -> None:
        self.own, self.at, self.size = own, at, len(own)

    def over(self, begin: int, end: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of tokens before text[begin:end], and those over it: id, begin, end. Places without a token are passed over."""
        found = (self.own.char_to_token(c - self.at) for c in range(begin, end))
        first = next((i for i in found if i is not None), self.size)
        ids, out = self.own.ids, []
        for i in range(first, self.size):
            a, b = self.own.token_to_chars(i)
            if a + self.at >= end:
                break
            out.append((ids[i], a + self.at, b + self.at))
        return first, out


Chunk = Pieces | Encoded


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.path, self.chunk, self.overlap, self.own = path, chunk, overlap, library(path)
        self.pieces = path.endswith(".model")
        if self.pieces:
            names = (self.own.id_to_piece(i) for i in range(self.own.get_piece_size()))
            self.provable = not any(regex.search("[^▁]▁", x) for x in names)
            self.points = _PIECE_SPACE
        else:
            self.provable, self.points = self._drops_space(), _SPACE

    def _drops_space(self) -> bool:
        """Whether the vocabulary drops white space, shown by encodings of each kind of it."""
        return all(not self.own.encode(c, add_special_tokens=False).ids for c in " \t\n\r\x0b\x0c\x85\xa0 　")

    def small(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.own.encode(texts, num_threads=1)]
        return [len(x) for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, text: str, at: int) -> Chunk:
        """A piece of text that begins at a place of the whole text, encoded."""
        if self.pieces:
            out = self.own.encode(text, return_type="proto").pieces
            # places are in bytes; count the characters that begin before them
            raw = np.frombuffer(text.encode(), np.uint8)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            table = np.array([(p.id, p.begin, p.end) for p in out], np.int64).reshape(-1, 3)
            table[:, 1:] = chars[table[:, 1:]] + at
            return Pieces(table)
        return Encoded(self.own.encode(text, add_special_tokens=False), at)

    def _splice(self, text: str, left: Chunk, right: Chunk, begin: int, end: int) -> tuple[int, int, int] | None:
        """A proven common boundary in text[begin:end] and the tokens of left and of right before it, or None."""
        points = [m.start() for m in self.points.finditer(text, begin + 1, end - 1)]
        sides = [chunk.over(begin, end) for chunk in (left, right)] if len(points) > 1 else []
        for p, q in pairwise(points):
            if q - p < 2:
                continue
            seen, before = [], []
            for first, tokens in sides:
                crossing = any(a < p < b or a < q < b for _, a, b in tokens)
                seen.append(None if crossing else [t for t in tokens if p <= t[1] < q])
                before.append(first + sum(a < p for _, a, _ in tokens))
            if seen[0] and seen[0] == seen[1]:
                return p, *before
        return None

    def long(self, text: str) -> int:
        if not self.provable:
            return self.small([text])[0]
        n, total, base, counted = len(text), 0, 0, 0
        end = min(self.chunk, n)
        left = self._chunk(text[:end], 0)
        while end < n:
            overlap, size, point = self.overlap, self.chunk, None
            while point is None:
                at = max(base, end - overlap)
                stop = min(n, at + max(size, 2 * overlap))
                if at == base and overlap > end - base:  # no proven point in the whole chunk: one larger chunk
                    size *= 2
                    end = min(n, base + size)
                    first = base + (self.pieces and base > 0)  # the library itself puts a space before a text
                    left, counted = self._chunk(text[first:end], first), 0
                    if end == n:
                        return total + left.size
                    overlap = self.overlap
                    continue
                right = self._chunk(text[at:stop], at)
                point = self._splice(text, left, right, at, end)
                overlap *= 2
            base, of_left, of_right = point
            total += of_left - counted
            end, left, counted = stop, right, of_right
        return total + left.size - counted

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, n in zip(short, self.small([texts[i] for i in short]) if short else []):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out


_COUNTERS: dict[tuple, Counter] = {}


def counter(*args) -> Counter:
    if args not in _COUNTERS:
        _COUNTERS[args] = Counter(*args)
    return _COUNTERS[args]


def count_tokens(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keys, n_bytes and n_tokens of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, chunk, overlap)
        for batch in batches:
            for part in parts(batch, len(keys), 1 << 20):
                texts = [t or "" for t in part.column(len(keys)).to_pylist()]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(sizes, pa.int64()), pa.array(own.counts(texts), pa.int64())], [*keys, "n_bytes", "n_tokens"])

    return df.select(*keys, text).mapInArrow(run, key_schema(df, keys) + ", n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether it is over 2048 tokens."""
    import public_tokenizers as vocabulary

    counted = count_tokens(documents(spark, sf_dir), vocabulary.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
