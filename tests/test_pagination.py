"""Parts of works against the rule applied work by work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solfa.operators import pagination


def one_by_one(sizes, limit, used=0, part=1):
    out = []
    for n in sizes:
        if used and used + n > limit:
            part, used = part + 1, 0
        out.append(part)
        used += n
        if used >= limit:
            part, used = part + 1, 0
    return out, used, part


@pytest.mark.parametrize("seed", range(40))
def test_a_block_is_a_function_of_the_fill(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 7, 30])
    sizes = np.array([rng.choice([1, 1, 2, 3, limit, limit + 4, rng.randint(1, 40)]) for _ in range(rng.randint(1, 60))])
    fills, opened = pagination.transitions(sizes, limit)
    for used in range(limit):
        rows, left, part = one_by_one(sizes, limit, used)
        assert pagination.place(sizes, limit, used).tolist() == rows
        assert (fills[used], 1 + opened[used]) == (left, part)


def works(spark, sizes):
    """sizes: file -> number of rows of each work."""
    each = [(f, i * 3, n) for f, v in sizes.items() for i, n in enumerate(v)]
    table = spark.createDataFrame(each, "name string, work_seq long, n int")
    return table.select("name", "work_seq", F.explode(F.sequence(F.lit(1), "n")).alias("file"))


@pytest.mark.parametrize("block, fan", [(3, 2), (40, 64), (10_000, 64)])
def test_parts_over_many_blocks(spark, monkeypatch, block, fan):
    """One file holds most works and spans many blocks, over several levels of the tree; one has no name."""
    monkeypatch.setattr(pagination, "FAN", fan)
    rng = random.Random(5)
    sizes = {"hot": [rng.choice([1, 2, 3, 9, 10, 15]) for _ in range(120)], "b": [10, 1, 9, 1, 25, 1], "c": [1], None: [4, 4, 4]}
    out = pagination.parts(works(spark, sizes), "name", 10, block).collect()
    assert {(r["name"], r["work_seq"], r["part"]) for r in out} == {(f, i * 3, p) for f, v in sizes.items() for i, p in enumerate(one_by_one(v, 10)[0])}
    assert len(out) == sum(map(len, sizes.values()))


def test_no_rows(spark):
    assert pagination.parts(works(spark, {"a": [1]}).limit(0), "name").collect() == []
