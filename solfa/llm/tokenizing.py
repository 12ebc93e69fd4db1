"""Public tokenizers inside tasks: one loaded library object for each Python worker."""

from __future__ import annotations

import os
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import regex

_LOADED: dict[str, object] = {}

#: The byte that each character of a byte-level vocabulary shows: itself where it can be seen, others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTES = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def library(path: str):
    """The tokenizers or sentencepiece object for a vocabulary file, by its ending."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            _LOADED[path] = own
    return _LOADED[path]


#: str.split() takes the first four for white space, the tokenizers library doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Lower-casing a whole text could make a special token, or a final sigma that the library doesn't make.
_CASED = regex.compile("<\\||\u03a3")


class WordIds:
    """Ids of texts for a lower-casing vocabulary that drops white space: no token crosses it, so each run of other
    characters is encoded once by the library and kept, in two generations of max_entries (some 25 MB each).

    Words of letters only are one pre-token each, so many of them are encoded together and cut after each token that
    ends a word; ASCII marks after letters are a pre-token of their own."""

    def __init__(self, path: str, max_entries: int = 120_000, max_chars: int = 64) -> None:
        self.path, self.max_entries, self.max_chars = path, max_entries, max_chars
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = library(path).get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = self._by_ranks(vocabulary)

    def _by_ranks(self, vocabulary: dict[str, int]):
        """An encoder of words that each end in the byte 1, which stands for the mark of a word's end: it is united with the
        byte before it first, as the ids of bytes with the mark are below those of all merges."""
        import tiktoken

        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            plain = token.removesuffix("</w>")
            if set(plain) <= BYTES.keys():
                ranks[bytes(map(BYTES.__getitem__, plain)) + b"\x01" * (plain != token)] = i
        merged = sorted(i for token, i in ranks.items() if len(token) > 1)
        if len(ranks) < 512 or merged[:256] != list(range(256, 512)):
            return None  # ids don't rise in that order: the library encodes all
        return tiktoken.Encoding("letters", pat_str="\\p{L}+\x01", mergeable_ranks=ranks, special_tokens={})

    def _each(self, texts: list[str]) -> list[bytes]:
        out = library(self.path).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in out]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        joined = "\x01".join(words) + "\x01"
        if self.letters is not None and joined == joined.lower() and is_normalized("NFC", joined):
            ids = np.array(self.letters.encode_ordinary(joined), "<u4")
        else:
            ids = np.array(library(self.path).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        flat, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [flat[i:j] for i, j in zip(at, at[1:])]

    def _table(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Ids of every word of texts; only words of letters are kept for later calls."""
        if len(self.memo) > self.max_entries:
            self.older, self.memo = self.memo, {}
        memo, older, table = self.memo, self.older, {}
        marked, others, letters = [], set(), []
        for w in set().union(*texts):
            ids = memo.get(w)
            if ids is None and (ids := older.get(w)) is not None:
                memo[w] = ids
            if ids is not None:
                table[w] = ids
            elif w.isalpha():
                letters.append(w)
            elif (stem := w.rstrip(punctuation)).isalpha():
                marked.append((w, stem, w[len(stem) :]))
            else:
                others.add(w)
        others.update({tail for _, _, tail in marked}.difference(table))
        for w in {stem for _, stem, _ in marked}.difference(letters, table):
            ids = memo.get(w)
            if ids is None and (ids := older.get(w)) is not None:
                memo[w] = ids
            if ids is None:
                letters.append(w)
            else:
                table[w] = ids
        for at in range(0, len(letters), 2048):
            part = letters[at : at + 2048]
            found = self._words(part)
            table.update(zip(part, found))
            memo.update((w, ids) for w, ids in zip(part, found) if len(w) <= self.max_chars)
        others = list(others)
        for at in range(0, len(others), 2048):
            table.update(zip(others[at : at + 2048], self._each(others[at : at + 2048])))
        table.update((w, table[stem] + table[tail]) for w, stem, tail in marked)
        return table

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [not _SEPARATORS.search(t) for t in texts]
        split = [((t if _CASED.search(t) else t.lower()).split() if p else []) for t, p in zip(texts, plain)]
        ids = self._table(split).__getitem__
        return [b"".join(map(ids, words)) if p else self._each([t])[0] for t, words, p in zip(texts, split, plain)]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


#: White space but the space and the line end, as str.isspace() or the tokenizers library has it.
_OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_UNEVEN = ["  ", "\n\n", " \n", "\n "]


class SpacedIds:
    """Ids of texts for a byte-level vocabulary, whose pre-tokens take at most one space, and that before them: texts whose
    words are parted by single spaces and line ends are cut before each of these. Each word is encoded once and kept, in
    two generations of max_entries. Other texts, and those with a token that the vocabulary adds, go to the library whole.

    ASCII marks after letters are a pre-token of their own. Words of letters are one pre-token each; many of them are encoded
    together by ranks (ids of a byte-level vocabulary rise in the order of its merges) and cut before each space."""

    def __init__(self, path: str, max_entries: int = 300_000, max_chars: int = 64) -> None:
        import tiktoken

        self.path, self.max_entries, self.max_chars = path, max_entries, max_chars
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        own = library(path)
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]
        ranks = {bytes(map(BYTES.__getitem__, token)): i for token, i in own.get_vocab().items() if token not in self.added}
        self.letters = tiktoken.Encoding("letters", pat_str=r" ?\p{L}+", mergeable_ranks=ranks, special_tokens={})
        self.first = np.zeros(max(ranks.values()) + 1, bool)
        self.first[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        out = library(self.path).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in out]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it."""
        ids = np.array(self.letters.encode_ordinary(" " + " ".join(words)), "<u4")
        starts = np.flatnonzero(self.first[ids])
        if len(starts) != len(words) or starts[0]:
            return self._each([" " + w for w in words])
        flat, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [flat[i:j] for i, j in zip(at, at[1:])]

    def _table(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word. One that starts with a line end has that in place of the space, one with \\r neither."""
        if len(self.memo) > self.max_entries:
            self.older, self.memo = self.memo, {}
        memo, older, table = self.memo, self.older, {}
        marked, letters, others = [], [], []
        for w in words:
            ids = memo.get(w)
            if ids is None and (ids := older.get(w)) is not None:
                memo[w] = ids
            if ids is not None:
                table[w] = ids
            elif w.isalpha():
                letters.append(w)
            elif (stem := w.rstrip(punctuation)).isalpha():
                marked.append((w, stem, "\r" + w[len(stem) :]))
            else:
                others.append(w)
        parts = {x for _, stem, tail in marked for x in (stem, tail)}
        for w in parts.difference(letters, others, table):
            ids = memo.get(w)
            if ids is None and (ids := older.get(w)) is not None:
                memo[w] = ids
            if ids is not None:
                table[w] = ids
            else:
                (letters if w.isalpha() else others).append(w)
        exact = lambda part: self._each([w.removeprefix("\r") if w[:1] in ("\r", "\n") else " " + w for w in part])
        for missing, found in ((letters, self._words), (others, exact)):
            for at in range(0, len(missing), 2048):
                part = missing[at : at + 2048]
                ids = found(part)
                table.update(zip(part, ids))
                memo.update((w, i) for w, i in zip(part, ids) if len(w) <= self.max_chars)
        table.update((w, table[stem] + table[tail]) for w, stem, tail in marked)
        return table

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = [*_OTHER_SPACE[:8], *_UNEVEN, *self.added]
        plain = [not any(a in t for a in (odd if t.isascii() else odd + _OTHER_SPACE[8:])) for t in texts]
        split = [("\r" + t.replace("\n", " \n")).split(" ") if p else [] for t, p in zip(texts, plain)]
        ids = self._table(set().union(*split)).__getitem__
        return [b"".join(map(ids, words)) if p else self._each([t])[0] for t, words, p in zip(texts, split, plain)]


_SPACED: dict[str, SpacedIds] = {}


def spaced_ids(path: str) -> SpacedIds:
    if path not in _SPACED:
        _SPACED[path] = SpacedIds(path)
    return _SPACED[path]
