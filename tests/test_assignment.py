"""Pairs dealt in rounds against the rule that deals them one by one."""

import random

import pytest

from solfa.operators import matching

SCHEMA = "file string, place int, header string, position int, target string, score double, header_score double, method string"


def one_by_one(rows):
    out = set()
    for file in {r[0] for r in rows}:
        pairs = sorted((r for r in rows if r[0] == file and r[5] > 0), key=lambda r: (-r[5], r[1], r[3]))
        main, used = {}, set()
        for r in pairs:
            if r[1] not in used and r[3] not in main and (r[7] != "fuzzy" or r[5] >= matching.LEAST_FUZZY):
                main[r[3]] = r
                used.add(r[1])
        out |= {(file, p, r[1], 0) for p, r in main.items()}
        extra = dict.fromkeys(main, 0)
        for r in pairs:
            if r[1] not in used and r[3] in main and r[5] >= matching.SURE:
                used.add(r[1])
                extra[r[3]] += 1
                out.add((file, r[3], r[1], extra[r[3]]))
    return out


def dealt(spark, rows):
    return [(r["file"], r["position"], r["place"], r["nth"]) for r in matching.assign(spark.createDataFrame(rows, SCHEMA)).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_rounds_give_the_greedy_result(spark, seed):
    rng = random.Random(seed)
    score = lambda: rng.choice([0.0, 0.3, 0.5, 0.6, 0.9, 0.95, 1.0]) if seed else rng.random()
    rows = [(f"f{f}", h, f"h{h}", t, f"t{t}", s, s, rng.choice(["fuzzy", "exact"])) for f in range(4) for h in range(rng.randint(1, 14)) for t in range(9) for s in [score()]]
    out = dealt(spark, rows)
    assert len(out) == len(set(out)) and set(out) == one_by_one(rows)


def test_a_chain_takes_a_round_a_pair(spark):
    """Each pair waits for the one before it: the most rounds there can be."""
    rows = []
    for k in range(6):
        rows += [("f", k, f"h{k}", k, f"t{k}", 0.9 - 0.02 * k, 0.0, "exact"), ("f", k + 1, f"h{k + 1}", k, f"t{k}", 0.89 - 0.02 * k, 0.0, "exact")]
    assert set(dealt(spark, rows)) == one_by_one(rows)


def test_repeats_nulls_and_no_rows(spark):
    row = ("f", 0, "h", 0, "t", 0.9, 0.9, "exact")
    assert dealt(spark, [row, row, ("f", 0, "h", 0, "t", 0.2, 0.2, "exact"), (None, *row[1:]), ("f", None, *row[2:]), (*row[:5], None, None, "exact")]) == [("f", 0, 0, 0)]
    assert matching.assign(spark.createDataFrame([row], SCHEMA).limit(0)).collect() == []
