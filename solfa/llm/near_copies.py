"""Near copies among documents: pairs whose word shingles have an exact Jaccard similarity of THRESHOLD or more.

A text's set is its shingles of WIDTH words, in lower case; a text of fewer words has one shingle, and a wordless text
an empty set. Candidates come from the SimHash index (fingerprints over the same shingles within its few bits) and from
keys of ROWS minima, of which similar texts share one of BANDS: the fingerprints of texts at 0.8 differ in about 8 to 10
bits, which no index over 64 bits can bear at scale. All are verified, those of crowded keys as in line_dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .line_dedup import SEEDS as LINE_SEEDS
from .line_dedup import similar_links
from .shared import written

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SEEDS = [*LINE_SEEDS, *(~s * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for s in LINE_SEEDS)][: BANDS * ROWS]


def word_set(text: Column | str) -> Column:
    """The set of hashed word shingles."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")

    def found(own: Column) -> Column:
        n = F.size(own)
        many = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*(F.get(own, i + j) for j in range(WIDTH))))
        few = F.when(F.get(own, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(own, " "))))
        return F.when(n >= WIDTH, many).otherwise(few)

    return F.array_distinct(F.get(F.transform(F.array(words), found), F.lit(0)))


def signed(texts: DataFrame) -> DataFrame:
    """id and keys (an array of the keys of all bands) of each text that has words."""
    hashes = texts.select("id", word_set("line").alias("set")).select("id", F.explode_outer("set").alias("h")).filter("h is not null")
    minima = [F.min(F.shiftright(F.col("h").bitwiseXOR(F.lit(s)), 32).cast("int")).alias(f"m{i}") for i, s in enumerate(SEEDS)]
    keys = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    return hashes.groupBy("id").agg(*minima).select("id", F.array(*keys).alias("keys"))


def fingerprint_links(texts: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """a, b: ids of texts (id, line) that the SimHash index joins: those of one fingerprint, and fingerprints within distance bits."""
    prints = written(simhash.fingerprints(texts, "line", ("id",), WIDTH), "prints")
    codes = written(prints.groupBy("fp").agg(F.min("id").alias("id")), "codes")
    same = prints.join(codes.withColumnRenamed("id", "b"), "fp").filter("id <> b").select(F.col("id").alias("a"), "b")
    return same.unionByName(simhash.links(codes, distance)).distinct()


def near_links(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: ids of texts (id, line) whose similarity reaches threshold, as similar_links() gives those of lines."""
    return similar_links(texts, written(signed(texts), "signatures"), threshold, word_set, fingerprint_links(texts))
