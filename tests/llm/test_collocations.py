"""Collocations against SQL and against phrases counted one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from solfa.llm import collocations as C

_rng = random.Random(11)
WORDS = ["the", "The", "of", "a", "a", "a", "ÉTÉ", "été", "new", "york", "city", "x\x00y", "日本"]
TEXTS = [
    None, "", " ", "...", "a a a a a a", "new york city. new york city", "a " * 900, "New\tYork  City\x0bnew york city",
    *("".join(w + _rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ", "\r\n"]) for w in _rng.choices(WORDS, k=n)) for n in (1, 30, 300, 3000, 3000)),
]
LANGS = ["en", None, "de", "und", "en"]


def frame(spark, texts=TEXTS):
    rows = [(i, t, LANGS[i % 5], None if i % 2 else "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n long")


def expected(texts, least, top):
    count: dict = {}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for at in range(len(w) - k + 1):
                    count.setdefault(LANGS[i % 5] or "und", Counter())[tuple(w[at : at + k])] += 1
    out = []
    for lang, f in count.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        own = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, size, parts", [(3, 2000, 1 << 21, 1), (5, 20, 500, 4), (100, 2000, 2000, 3)])
def test_against_single_counts(spark, least, top, size, parts):
    rows = C.collocations(frame(spark).repartition(parts), least=least, top=top, size=size).collect()
    assert sorted(map(tuple, rows)) == expected(TEXTS, least, top)


def test_query_against_sql(same_rows):
    same_rows(C.op12_collocations, C.OP12_SQL)


def test_nothing(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [None, "..", "one two"])).count() == 0


def test_bitmaps_carry_over_words():
    own = np.random.default_rng(0).integers(-1, 5, 3000)
    maps = C.Bitmaps(own, 5)
    a, b, _, bits = maps.all_extended(maps.word, maps.block, maps.bits)
    found, n, *_ = C._summed(a * 5 + b, bits)
    plain = Counter(int(x) * 5 + int(y) for x, y in zip(own, own[1:]) if x >= 0 and y >= 0)
    assert dict(zip(found.tolist(), n.tolist())) == plain


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 10**11, 9 * 10**12, 2 * 10**11, 3 * 10**11
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) AS score").first()
    assert row["score"] == 1000 * a * n // (l * r)


def test_classes_are_bounded():
    word = np.repeat(np.arange(9), [5, 1, 1, 1, 30, 2, 2, 2, 7])
    found = list(C.classes(word, 8))
    assert found[0][0] == 0 and found[-1][1] == len(word) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert all(j - i <= 8 or len(set(word[i:j])) == 1 for i, j in found)
    assert all(word[i - 1] != word[i] for i, _ in found[1:])
    assert not list(C.classes(word[:0], 8))
