"""The corpus pipeline: each stage on what the one before kept, and the rows of the whole."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from solfa.llm.shared import documents, written
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage but the last keeps of the small table."""
    docs, out = documents(spark, SF_DIR), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append((docs, docs := written(stage(spark, docs, SF_DIR), name)))
    return dict(zip((name for name, _ in corpus_pipeline.STAGES), out))


def texts(df) -> dict[int, str]:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(kept):
    for before, after in kept.values():
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert set(texts(after)) <= set(texts(before))
        assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] is not None) or after is kept["language_id"][1]


def test_language_stage_keeps_texts_as_they_are(kept):
    before, after = map(texts, kept["language_id"])
    assert len(after) >= 0.9 * len(before)
    assert all(before[i] == t for i, t in after.items())


def test_language_stage_moves_texts_once(spark):
    plan = corpus_pipeline.language_id(spark, documents(spark, SF_DIR), SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    node = next(x for x in plan.split("\n") if "MapInArrow" in x)
    assert "rest" not in node and node.partition("[")[0].count("text#") == 1


def test_lines_only_go(kept):
    before, after = map(texts, kept["line_dedup"])
    assert set(before) == set(after)
    for i, text in after.items():
        lines = iter(before[i].split("\n"))
        assert all(line in lines for line in text.split("\n")) or text == ""


def shingles(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_group_stays(kept):
    before, after = map(texts, kept["near_dedup"])
    sets = {i: shingles(t or "") for i, t in before.items()}
    order, root = sorted(before), {i: i for i in before}
    for a in order:
        for b in order:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert set(after) == set(root.values())
    assert all(before[i] == t for i, t in after.items())


def test_no_passage_repeats_whole(kept):
    before, after = map(texts, kept["suffix_dedup"])
    assert set(before) == set(after)
    windows = {i: [tuple(w[k : k + 51]) for k in range(len(w) - 50)] for i, t in before.items() for w in [t.split()]}
    seen = Counter(w for own in windows.values() for w in own)
    for i, own in windows.items():
        assert any(seen[w] > 1 for w in own) == (after[i] != before[i])


def test_pieces_of_all_that_stay(spark, kept):
    packed = corpus_pipeline.STAGES[-1][1](spark, kept["suffix_dedup"][1], SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == set(texts(kept["suffix_dedup"][1]))
    for doc in {r["doc_id"] for r in packed}:
        own = [r for r in packed if r["doc_id"] == doc]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, an extra column; then a table with no rows."""
    english = "the house and the garden were quiet in the evening " * 4
    rows = [(i, f"{english}{i} {chr(97 + i) * 9}", "en", "s", 1) for i in range(6)]
    rows += [(6, None, None, None, None), (7, "", "en", None, 0), (None, english, None, None, None), (0, rows[0][1], "en", "s", 1), (8, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as rest", "2 as score")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in found} <= {None, *range(6)} and len(found) >= 1
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_near_copies_go(spark):
    """Pairs of five-word similarity 0.8 to 0.9 by scattered word edits, a large group of them, and clashing ids."""
    own = random.Random(31)
    vocabulary = ["".join(own.choices("abcdefghijklmnoprstuvw", k=own.randint(2, 9))) for _ in range(3000)]

    def copy(words, edits):
        out = list(words)
        for at in own.sample(range(len(out)), edits):
            out[at] = own.choice(vocabulary)
        return out

    def similarity(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    pairs = []
    while len(pairs) < 200:
        a = own.choices(vocabulary, k=200)
        b = copy(a, own.randint(2, 5))
        if 0.8 <= similarity(a, b) < 0.9:
            pairs.append((a, b))
    found = [t for pair in pairs for t in pair]
    base = own.choices(vocabulary, k=200)
    found += [copy(base, 1) for _ in range(100)]  # each 0.9 or more to the next
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(found)]
    rows += [(0, "another text of the same id as the first one has", "en", "s", 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(after) == len(set(after)) and (0, rows[0][1]) in after and (0, rows[-2][1]) in after
    assert sum(i >= 400 for i, _ in after) == 1
    missed = sum(i < 400 and i % 2 for i, _ in after)
    print("missed", missed, "of 200")
    assert missed <= 1
