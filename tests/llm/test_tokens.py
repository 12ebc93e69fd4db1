"""Byte-level BPE, token counts and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabulary
import pytest
import tiktoken
from tokenizers import Tokenizer

from solfa.llm import bpe, packing, token_counts
from solfa.llm.shared import written
from solfa.llm.tokenizing import BYTES, WordIds

RANKS, WORDS, PIECES = (vocabulary.path(x) for x in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
_rng = random.Random(3)
WORDY = "naïve café  Straße ΣΊΣΥΦΟΣ don't 12345 \t\n\n  <|endoftext|> <|startoftext|> 日本語 🙂🙂 á …—“x” \x1c\x1d ﬁ Ⅳ İ".split(" ")
TEXTS = [
    None, "", " ", "\n", "a", "<|endoftext|>", "the the the", "the the the", "abcdefgh" * 4000, "́" * 50, "🙂" * 300,
    *(" ".join(_rng.choices(WORDY, k=n)) for n in (1, 5, 40, 400, 3000)),
    "".join(_rng.choices("ab \n\t.é　", k=20_000)),
]


def frame(spark, texts=TEXTS):
    """Documents with columns whose names clash with the operators' own, and nulls in all."""
    rows = [(i, t, None if i % 2 else "x", None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string, length long")


def test_ids_and_round_trip(spark):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = bpe.encode_column(frame(spark), RANKS, vocabulary.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = TEXTS[row["doc_id"]] or ""
        assert bytes(row["ids"]) == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert bytes(row["decoded"]) == text.encode()


def test_rank_queue_gives_lowest_rank_then_leftmost():
    queue, entries = bpe.RankQueue(), [(_rng.randrange(50_000), _rng.randrange(1000)) for _ in range(2000)]
    for x in entries:
        queue.put(*x)
    taken = []
    while (x := queue.take()) is not None:
        taken.append(x)
    assert taken == sorted(entries)


@pytest.mark.parametrize("path", [WORDS, PIECES])
@pytest.mark.parametrize("chunk, overlap", [(65_536, 512), (500, 20), (64, 4)])
def test_counts(spark, path, chunk, overlap):
    if path == WORDS:
        own = Tokenizer.from_file(path)
        expected = [len(own.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    else:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(own.encode(t or "")) for t in TEXTS]
    rows = token_counts.count_tokens(frame(spark), path, chunk=chunk, overlap=overlap).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == dict(enumerate(expected))
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}


def test_packing(spark):
    own = Tokenizer.from_file(WORDS)
    rows = packing.pack(written(packing.pieces(frame(spark), WORDS), "pieces")).collect()
    for i, text in enumerate(TEXTS):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // packing.CAPACITY) + 2


def test_differencing_gives_near_equal_windows():
    own = np.random.default_rng(0)
    # pieces well below a window, then about two to a window, where equal sums leave more room
    for sizes, most in ((own.integers(1, 1000, 700), 1.02), (own.integers(1, 4000, 700), 1.06)):
        sums = np.bincount(packing.windows(sizes, 4096), sizes)
        assert sums.max() <= 4096
        assert len(sums) <= most * sizes.sum() / 4096 + 1
    assert packing.windows(np.array([4095, 4095, 2]), 4096).tolist().count(0) >= 1


def test_nothing(spark):
    none = frame(spark, [])
    assert bpe.encode_column(none, RANKS, vocabulary.PATTERN).count() == 0
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert packing.pack(written(packing.pieces(none, WORDS), "pieces")).count() == 0


def test_digests_of_ids(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in bpe.op4_byte_bpe(spark, str(tmp_path)).collect()}
    assert rows[0]["n_tokens"] == 0
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[6]["decoded_sha256"] == hashlib.sha256(b"the the the").hexdigest()
    counted = {r["doc_id"]: r for r in token_counts.op7_token_counts(spark, str(tmp_path)).collect()}
    assert [r for r in counted.values() if r["over_limit"] != (r["n_tokens"] > 2048)] == []


def test_words_of_letters_by_ranks():
    own, mine = Tokenizer.from_file(WORDS), WordIds(WORDS, max_entries=3000)
    assert mine.letters is not None
    known = sorted(t.removesuffix("</w>") for t in own.get_vocab())
    shown = [bytes(BYTES[c] for c in t if c in BYTES).decode("utf-8", "ignore") for t in known]
    words = [w.lower() for w in shown if w.isalpha()] + ["straße", "éàü", "ﬁn", "각", "각", "日本語", "ǆ", "ıi̇", "ʼn", "ꟈ", "K".lower(), "Å".lower()]
    words += ["".join(_rng.choices("etaoinshrdluéß", k=_rng.randint(1, 14))) for _ in range(20_000)]
    for texts in (words, [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)], [w + _rng.choice(".,!'?") for w in words[-3000:]]):
        expected = own.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == [x.ids for x in expected]
