"""Line dedup, SimHash groups and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from solfa.llm import graph, line_dedup, simhash, suffix_dedup

_rng = random.Random(17)
VOCABULARY = ["".join(_rng.choices("abcdefghijklmnoprstuvw", k=_rng.randint(3, 9))) for _ in range(600)]


def words(n: int) -> str:
    return " ".join(_rng.choices(VOCABULARY, k=n))


def changed(text: str, places: int) -> str:
    out = list(text)
    for _ in range(places):
        out[_rng.randrange(len(out))] = _rng.choice("xyz")
    return "".join(out)


def roots(n: int, links) -> list[int]:
    root = list(range(n))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((up(a), up(b)))
        root[b] = a
    return [up(i) for i in range(n)]


def frame(spark, texts):
    rows = [(i, t, None, "s" if i % 3 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, line string, n_removed string")


# lines


def shingle_set(line: str) -> set[str]:
    w = line_dedup.WIDTH
    return {line[i : i + w] for i in range(len(line) - w + 1)}


def brute_lines(texts):
    where, order = {}, []
    for doc, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" ") and line not in where:
                where[line] = len(order)
                order.append((doc, pos, line))
    sets = [shingle_set(x[2]) for x in order]
    links = [(a, b) for a, b in combinations(range(len(order)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {order[r][:2] for r in roots(len(order), links)}
    out = []
    for doc, text in enumerate(texts):
        if text is None:
            out.append((None, 0, 0))
            continue
        own = text.split("\n")
        stay = [x for pos, x in enumerate(own) if not x.strip(" ") or (doc, pos) in kept]
        out.append(("\n".join(stay), sum(bool(x.strip(" ")) for x in own), len(own) - len(stay)))
    return out


def test_lines(spark):
    base = [words(n) for n in (3, 6, 9, 12, 14, 16, 20, 30, 60) for _ in range(4)]
    pool = [*base, *base, *(x + " zz" for x in base if len(x) > 60), *(x[: len(x) // 2] for x in base), "ab", "ab", "", " "]
    hub = words(25)
    pool += [changed(hub, 1) for _ in range(60)]  # over CROWD lines share keys
    _rng.shuffle(pool)
    texts = [None, "", "\n\n", *("\n".join(pool[i : i + 5]) for i in range(0, len(pool), 5)), words(5000)]
    texts.append(texts[4])
    expected = brute_lines(texts)
    rows = line_dedup.dedup(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows} == dict(enumerate(expected))


def test_templated_lines(spark):
    """Lines of one template share crowded keys, but few are similar to the most central one."""
    own = random.Random(23)
    fields = [["".join(own.choices("abcdefghijklmnoprstuvw", k=3)) for _ in range(18)] for _ in range(4)]
    fixed = ["".join(own.choices("abcdefghijklmnoprstuvw", k=12)) for _ in range(11)]
    lines = sorted({" ".join([*fixed[:2], v[0], *fixed[2:5], v[1], *fixed[5:7], v[2], *fixed[7:9], v[3], *fixed[9:]]) for _ in range(2000) for v in [[own.choice(f) for f in fields]]})
    own.shuffle(lines)
    sets = [shingle_set(x) for x in lines]
    place = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    table = np.zeros((len(lines), len(place)), np.float32)
    for i, x in enumerate(sets):
        table[i, [place[y] for y in x]] = 1
    common, sizes = table @ table.T, table.sum(1)
    a, b = np.nonzero(np.triu(common >= 0.8 * (sizes[:, None] + sizes[None] - common), 1))
    expected = roots(len(lines), zip(a.tolist(), b.tolist()))
    kept = [r["doc_id"] for r in line_dedup.dedup(frame(spark, lines)).collect() if not r["n_removed"]]
    assert 100 < len(set(expected)) < len(lines) - 100
    assert sorted(kept) == sorted(set(expected))


def test_repeated_phrases(spark):
    """Lines of one set of shingles, whose phrase repeats a few times or many."""
    lines = ["spam eggs " * 4, "spam eggs " * 20, "- " * 10 + "-", "- " * 40 + "-", "a quite different line of text"]
    rows = line_dedup.dedup(frame(spark, lines)).collect()
    assert sorted(r["doc_id"] for r in rows if not r["n_removed"]) == [0, 2, 4]


def test_long_lines_meet(spark):
    """Pairs of long lines at a similarity of about 0.8 by scattered single edits share a key."""
    own, lines = random.Random(29), []
    while len(lines) < 1200:
        line = " ".join(own.choices(VOCABULARY, k=30))
        edited = list(line)
        for at in own.sample(range(len(line)), 3):
            edited[at] = "z"
        x, y = shingle_set(line), shingle_set("".join(edited))
        if 0.8 <= len(x & y) / len(x | y) < 0.82:
            lines += [line, "".join(edited)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    keys = {}
    for r in line_dedup.signed(rows).collect():
        keys.setdefault(r["id"], set()).update(r["keys"])
    met = sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(lines), 2))
    print("met", met, "of", len(lines) // 2)
    assert met >= 0.99 * len(lines) // 2


def test_minima_are_not_shuffled(spark):
    """Copies are united before they are signed, and each line is signed where it is dealt."""
    lines = line_dedup.split_lines(frame(spark, ["one line of a text\n" * 50])).groupBy("id").agg(F.min("pos").alias("first"), F.min("line").alias("line"))
    signed = line_dedup.signed(lines, "first")
    assert signed.count() == 1
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_line_without_shingles_has_no_keys(spark):
    rows = line_dedup.signed(spark.createDataFrame([(1, "short"), (2, "long enough")], "id long, line string")).collect()
    assert {r["id"]: len(r["keys"]) for r in rows} == {1: 0, 2: line_dedup.BANDS}


def test_hashes_of_lines_of_any_bytes(spark):
    """Lines cut by bytes have the hashes of their shingles, as lines cut by characters have."""
    lines = ["", "seven77", "eight888", "abcdefgh" * 9, "na\u00efve caf\u00e9 line", "tab\tand\x00nul bytes"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    hashes = spark.createDataFrame([(i, x) for i, line in enumerate(lines) for x in sorted(shingle_set(line))], "id long, s string")
    expected = {i: set() for i in range(len(lines))}
    for r in hashes.select("id", F.xxhash64("s").alias("h")).collect():
        expected[r["id"]].add(r["h"])
    found = {r["id"]: r["set"] for r in rows.select("id", line_dedup.hashed("line").alias("set")).collect()}
    assert {i: set(x) for i, x in found.items()} == expected
    assert all(len(x) == len(set(x)) for x in found.values())


def test_no_lines(spark):
    assert line_dedup.dedup(frame(spark, [])).count() == 0
    assert [r["n_removed"] for r in line_dedup.dedup(frame(spark, [None, ""])).collect()] == [0, 0]


# fingerprints


def brute_fingerprint(text: str | None) -> int:
    own = "".join(c.lower() if c.isascii() else c for c in text or "")
    tokens = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in own).split(" ") if x]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash(spark, bucket):
    base = [words(n) for n in (1, 2, 3, 20, 80, 200, 400) for _ in range(6)]
    texts = [None, "", " \t\n", "É é ß", *base, *base[::2], *(f"{x} end" for x in base), *(x.upper() for x in base[:5]), words(30_000)]
    prints = [brute_fingerprint(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = dict(enumerate(zip(prints, roots(len(texts), links))))
    docs = frame(spark, texts)
    rows = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in rows} == expected
    codes = spark.createDataFrame(sorted({(p - (1 << 64) if p >> 63 else p): i for i, p in reversed(list(enumerate(prints)))}.items()), "fp long, id long")
    found = simhash.links(codes, 3, bucket).collect()
    ids = sorted(r["id"] for r in codes.collect())
    place = {x: i for i, x in enumerate(ids)}
    ours = roots(len(ids), [(place[r["a"]], place[r["b"]]) for r in found])
    theirs = roots(len(ids), [(place[a], place[b]) for a, b in links if a in place and b in place])
    assert ours == theirs


def test_dense_fingerprints(spark):
    """Many codes near each other, in buckets over the bound at several depths."""
    own = random.Random(5)
    centres = [own.getrandbits(64) for _ in range(6)]
    codes = sorted({c ^ sum(1 << own.randrange(64) for _ in range(own.randint(0, 5))) & (1 << 64) - 1 for c in centres for _ in range(120)})
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    found = simhash.links(spark.createDataFrame(rows, "fp long, id long"), 3, 32).collect()
    links = [(a, b) for a, b in combinations(range(len(codes)), 2) if (codes[a] ^ codes[b]).bit_count() <= 3]
    assert roots(len(codes), [(r["a"], r["b"]) for r in found]) == roots(len(codes), links)


def test_no_fingerprints(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    own = random.Random(2)
    n, edges = 400, [(i, i + 1) for i in range(100)] + [(150, i) for i in range(151, 260)] + [(own.randrange(260, 400), own.randrange(260, 400)) for _ in range(60)]
    edges += edges[:50] + [(7, 7)]
    rows = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(rows).collect()}
    expected = {i: r for i, r in enumerate(roots(n, edges)) if r != i}
    assert got == expected


# passages


def brute_passages(texts):
    size, raws = suffix_dedup.LENGTH, [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(raw[i : i + size], digest_size=12).digest() for raw in raws for i in range(len(raw) - size + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[hashlib.blake2b(raw[i : i + size], digest_size=12).digest()] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(a and not b for a, b in zip(gone, b"\0" + bytes(gone)))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, kept))
    return out


def test_passages(spark):
    shared = [words(n) for n in (40, 60, 75, 90, 150, 600)]
    long = words(900)
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 401, "d" * 1200, "xy" * 700, long, long]
    for n in range(40):
        parts = [words(_rng.randint(0, 60)), _rng.choice(shared), words(_rng.randint(0, 30)), _rng.choice(shared)[_rng.randint(0, 40) :]]
        texts.append(_rng.choice(["", " ", "é"]).join(parts))
    texts += [long[:500], long[100:499], long[100:500], long[300:1300] + "é" * 300, "é" * 300, texts[20]]
    expected = brute_passages(texts)
    rows = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == dict(enumerate(expected))


def test_hot_passage(spark):
    """One passage in most documents, and documents whole repeated, over many small partitions."""
    hot, copy = words(120), words(300)
    texts = [f"{words(5)} {hot} {words(5)}" for _ in range(150)] + [copy] * 60
    expected = brute_passages(texts)
    rows = suffix_dedup.remove_repeats(frame(spark, texts).repartition(16)).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == {i: x[3] for i, x in enumerate(expected)}


def test_word_passages(spark):
    """Passages of 51 words go, whatever their bytes and white space; those of 50 stay."""
    own = random.Random(37)
    fresh = lambda n: " ".join(f"{own.choice('abcdef')}{own.getrandbits(20):x}" for _ in range(n))
    short, fifty, long = " ".join(own.choices("abcdefghijklm", k=51)), fresh(50), fresh(80)
    texts = [f"{fresh(5)} {x} {fresh(5)}" for x in (short, fifty, long) for _ in range(3)] + [long.replace(" ", "\n"), short[:-2], None, "é " + fresh(300)]
    spans = suffix_dedup.remove_repeats(frame(spark, texts), suffix_dedup.WORDS).collect()
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in spans}
    for i, t in enumerate(texts):
        repeat = short if i < 3 else long if 6 <= i < 9 else t if i == 9 else "\0"
        assert got[i] == (t or "").replace(repeat, "")


def test_no_passages(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("values", [2, 50, 1 << 62])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 50_000])
def test_multikey_quicksort(n, values):
    rng = np.random.default_rng(n)
    tokens = [rng.integers(0, values, n, dtype=np.uint64) * np.uint64(3) for _ in range(3)]
    order = suffix_dedup.multikey_order(*tokens)
    assert sorted(order.tolist()) == list(range(n))
    expected = np.lexsort(tokens[::-1])
    assert all((t[order] == t[expected]).all() for t in tokens)


def test_query_gives_the_text_that_stays(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(80))
    texts = [f"before {passage} after", f"other {passage}", "alone", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in suffix_dedup.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert hashlib.sha256(rows[i]["text"].encode()).hexdigest() == rows[i]["kept_sha256"]
        assert len(rows[i]["text"]) == len(t or "") - rows[i]["n_removed"]
    assert rows[0]["n_removed"] > 400 and passage not in rows[0]["text"] and rows[2]["text"] == "alone"
