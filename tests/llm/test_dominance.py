"""Dominance packing against the tokenizers library, brute force and its contract."""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as vocabulary
import pytest
from tokenizers import Tokenizer

from solfa.llm import dominance
from solfa.llm.shared import written
from solfa.llm.tokenizing import SpacedIds

PATH = vocabulary.path("byte_bpe_50k.json")
_rng = random.Random(7)
WORDY = "naïve café  Straße don't it's 12345 ab12 \t\n\n x\n  y<|endoftext|> 日本語 🙂🙂 á “x”). \x1c\x1d ﬁ \xa0 　z".split(" ")
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a\n b", "a \nb", "a  b\n\n\n c ", "<|endoftext|>", "the the the", "the the the", "abcdefgh" * 3000, "🙂" * 300, "x\t y", "a\xa0 b",
    *(" ".join(_rng.choices(WORDY, k=n)) for n in (1, 5, 40, 400, 3000)),
    *("".join(_rng.choices("ab \n.,'é", k=n)) for n in (20, 200, 2000, 20_000)),
    *(" ".join(_rng.choices(["one", "two,", "(three)", "it's", "\nfour"], k=n)) for n in (1021, 1022, 1023, 1024, 5000)),
]


def test_ids_of_every_token_and_of_even_texts():
    own, mine = Tokenizer.from_file(PATH), SpacedIds(PATH, max_entries=500)
    words = [own.decode([i]) for i in range(50_257)]
    even = ["".join(_rng.choices([" ", "\n"])[0] + w for w in _rng.choices(["a", "it's", "Ünder,", "x1", "(b).", "'tis", "don't'", "’s", "ab'", "’", "ﬁ"], k=30)) for _ in range(200)]
    for texts in ([" " + w for w in words], words, even, [e[1:] for e in even], [e + "\n" for e in even], [e + " " for e in even]):
        expected = own.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [x.ids for x in expected]


def frame(spark, texts=TEXTS):
    rows = [(None if i == 3 else i, t, None if i % 2 else 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length long, place string")


def test_pieces_and_sequences(spark):
    own = Tokenizer.from_file(PATH)
    rows = dominance.pack(written(dominance.pieces(frame(spark).repartition(4), PATH), "pieces")).collect()
    for i, text in enumerate(TEXTS):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, dominance.END_ID]
        mine = sorted((r for r in rows if r["doc_id"] == (None if i == 3 else i)), key=lambda r: r["piece"])
        at = 0
        for p, r in enumerate(mine):
            assert r["piece"] == p and r["start"] == at
            assert r["length"] == 1024 or p == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    check_sequences(rows)


def check_sequences(rows):
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_many_pieces_of_hot_lengths(spark):
    rng = np.random.default_rng(1)
    lengths = [*rng.integers(1, 1025, 3000).tolist(), *[300] * 2000, *[700] * 500]
    seen: dict = {}
    rows = []
    for i, n in enumerate(lengths):
        part = i % 7
        rows.append((i, 0, 0, n, 0, part, seen.get((part, n), 0)))
        seen[part, n] = seen.get((part, n), 0) + 1
    table = written(spark.createDataFrame(rows, dominance.PIECES).repartition(5), "pieces")
    packed = dominance.pack(table).collect()
    assert sorted(r["length"] for r in packed) == sorted(lengths)
    plain = dominance.best_fit(np.bincount(lengths, minlength=1025), 1024)
    assert check_sequences(packed) <= min(1.04 * sum(lengths) / 1024, sum(m for _, m in plain))


def optimum(sizes: tuple[int, ...], capacity: int) -> int:
    """The least number of bins, by trying everything."""

    @lru_cache(None)
    def least(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        head, rest = left[0], left[1:]

        def fill(at: int, room: int, out: tuple[int, ...]):
            yield out
            for i in range(at, len(rest)):
                if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                    yield from fill(i + 1, room - rest[i], (*out, i))

        return 1 + min(least(tuple(x for i, x in enumerate(rest) if i not in taken)) for taken in fill(0, capacity - head, ()))

    return least(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(150))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1 if seed % 2 else capacity // 5, capacity) for _ in range(rng.randint(1, 9))]
    counts = np.bincount(sizes, minlength=capacity + 1)
    kinds, left = dominance.reduced(counts, capacity)
    rest = [s for s in range(capacity + 1) for _ in range(left[s])]
    assert sum(m for _, m in kinds) + optimum(tuple(rest), capacity) == optimum(tuple(sizes), capacity)
    every = kinds + dominance.best_fit(left, capacity)
    held = np.zeros(capacity + 1, int)
    for members, m in every:
        assert m > 0 and sum(s * q for s, q in members) <= capacity
        for s, q in members:
            held[s] += q * m
    assert (held == counts).all()


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 80))), reverse=True)
        rooms: list[int] = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 64) - s)
        assert sum(m for _, m in dominance.best_fit(np.bincount(sizes, minlength=65), 64)) == len(rooms)


def test_nothing(spark):
    assert dominance.pack(written(dominance.pieces(frame(spark, []), PATH), "pieces")).count() == 0
