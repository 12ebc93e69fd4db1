"""Near matches against all pairs, the bound that prunes them, and stored scans."""

from __future__ import annotations

import difflib
import random
from collections import Counter

from solfa.operators import similar

_rng = random.Random(4)
FIRST = ["Asha", "Ravi", "Shreya", "Kumar", "Lata", "Élodie", "Ana María", "Mohammed", "Sunidhi", "Udit"]
LAST = ["Ghoshal", "Sanu", "Rao", "Mangeshkar", "Chauhan", "Narayan", "Núñez", "日本 太郎", "Sen"]


def names(n: int) -> list[str]:
    out = set()
    while len(out) < n:
        name = f"{_rng.choice(FIRST)} {_rng.choice(LAST)} {_rng.choice(LAST)}"
        for _ in range(_rng.randint(0, 4)):
            i = _rng.randrange(len(name))
            name = _rng.choice([name[:i] + name[i + 1 :], name[:i] + _rng.choice("aeiouhkl") + name[i:], name.lower(), " ".join(name.split()[::-1])])
        if name.strip():
            out.add(name)
    return sorted(out)


def table(spark, values):
    return spark.createDataFrame([(v, n) for v, n in values], "value string, n long")


def norm(v):
    return " ".join(v.split()).lower()


def near(v, base):
    x, y = norm(v), norm(base)
    ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    if " " in y:
        sort = lambda s: " ".join(sorted(s.split()))
        ratio = max(ratio, difflib.SequenceMatcher(None, sort(x), sort(y), autojunk=False).ratio())
    return ratio


def test_pairs_of_all_names(spark):
    every = names(10_000)
    bases = _rng.sample(every, 12)
    values, own = table(spark, [(v, 1) for v in every]).repartition(8), table(spark, [(v, 1) for v in bases])
    found = {(r["base"], r["value"]): r["ratio"] for r in similar.scored(values, own, 0.7).collect()}
    expected = {(b, v): r for b in bases for v in every if " ".join(v.split()) != " ".join(b.split()) and (r := near(v, b)) >= 0.7}
    assert found == expected and len(expected) > 100
    # few pairs reach Python, and those are the ones whose shared characters allow the ratio
    kept = similar.candidates(values, own, 0.7).count()
    assert len(expected) <= kept < 0.25 * len(every) * len(bases)


def test_bound_is_one(spark):
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaaa", "abcabcabc", "日本日本", "été", "a" * 300 + "b" * 9, "xyz", *names(30)]
    rows = similar.with_characters(similar.with_characters(table(spark, [(t, 1) for t in texts]).withColumnRenamed("value", "t"), "t", "a").drop("n"), "t", "b")
    left = rows.select("t", *(c for c in rows.columns if c.startswith("a")))
    right = rows.selectExpr("t AS u", *(c for c in rows.columns if c.startswith("b")))
    for r in left.join(right).select("t", "u", similar.shared_bound("a", "b").alias("bound")).collect():
        exact = sum((Counter(r["t"]) & Counter(r["u"])).values())
        assert exact <= r["bound"] <= min(len(r["t"]), len(r["u"]))


def test_counts_and_their_cache(spark, tmp_path):
    values = table(spark, [("Film Songs", 5), ("Film songs", 3), ("Songs Film", 2), ("other", 2), (" ", 9), ("Filn Songs", 1)])
    expected = {"Film Songs": (3, 3, 3), "Film songs": (3, 3, 3), "Songs Film": (3, 3, 3), "other": (0, 0, 0), "Filn Songs": (3, 3, 3)}
    seen = lambda df: {r["value"]: (r["c90"], r["c80"], r["c70"]) for r in df.collect()}
    assert seen(similar.similar_counts(values)) == expected
    assert similar.similar_counts(values, most=4).count() == 0
    folder = str(tmp_path / "cache")
    first, hit = similar.cached_counts(values, folder, 1, "Singer")
    assert seen(first) == expected and not hit
    again, hit = similar.cached_counts(values.repartition(3), folder, 1, "Singer")
    assert seen(again) == expected and hit
    for file_id, column, rows in ((2, "Singer", values), (1, "Genre", values), (1, "Singer", values.filter("n > 2"))):
        assert not similar.cached_counts(rows, folder, file_id, column)[1]
    assert similar.cached_counts(values, folder, 2, "Singer")[1] and not similar.cached_counts(values, folder, 1, "Singer")[1]
    empty = table(spark, [])
    assert not similar.cached_counts(empty, folder, 3, "Singer")[1]
    none, hit = similar.cached_counts(empty, folder, 3, "Singer")
    assert hit and none.count() == 0
