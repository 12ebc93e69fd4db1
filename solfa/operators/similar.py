"""Near matches among the distinct values of a column, by matching blocks (Ratcliff-Obershelp).

Matching blocks can't be expressed in the JVM, but a bound on them can: the ratio of two texts is at most twice the characters
they share (as multisets) over both lengths. A value's characters are counted in 64 buckets, eight to a 64-bit word, each
count as so many ones in its eight bits; what two values share is the number of ones that their words have in common. Characters beyond
eight of a bucket are counted apart. Reordered words share the same characters, so one bound covers both ratios, and only
pairs that pass it reach Python."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import merge_key, norm, token_sorted
from .overlay import values_fingerprint

#: Values that are scored, the most frequent first; columns of more different values are not scored.
CAP, MOST_DISTINCT = 1000, 25_000
WORDS, LANES = 8, 8


def character_words(text: Column) -> list[Column]:
    """The counts of a text's characters, by code point modulo 64, as ones in eight words."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) % (WORDS * LANES))

    def word(k: int) -> Column:
        own = F.transform(F.filter(codes, lambda c: F.floor(c / LANES) == k), lambda c: ((c % LANES) * 8).cast("int"))

        def one_more(total: Column, at: Column) -> Column:
            lane = F.call_function("shiftrightunsigned", total, at).bitwiseAND(F.lit(255).cast("bigint"))
            more = (lane * 2 + 1).bitwiseAND(F.lit(255).cast("bigint"))
            return total.bitwiseOR(F.call_function("shiftleft", more, at))

        return F.aggregate(own, F.lit(0).cast("bigint"), one_more)

    return [word(k) for k in range(WORDS)]


def with_characters(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with a text's words of characters, its length and how many characters the words leave out."""
    words = df.withColumns({f"{prefix}{k}": w for k, w in enumerate(character_words(F.col(text)))})
    held = sum((F.bit_count(f"{prefix}{k}") for k in range(WORDS)), F.lit(0))
    return words.withColumns({f"{prefix}n": F.length(text), f"{prefix}more": F.length(text) - held})


def shared_bound(a: str, b: str) -> Column:
    """At most so many characters are in both texts."""
    common = sum((F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.col(f"{b}{k}"))) for k in range(WORDS)), F.lit(0))
    return common + F.least(F.col(f"{a}more"), F.col(f"{b}more"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series, a_sorted: pd.Series, b_sorted: pd.Series) -> pd.Series:
    """2M/T of the matching blocks of candidate a and base b; of a base of several words the better of that and of sorted words."""
    out, direct, turned = [], difflib.SequenceMatcher(autojunk=False), difflib.SequenceMatcher(autojunk=False)
    for x, y, xs, ys in zip(a, b, a_sorted, b_sorted):
        if direct.b != y:
            direct.set_seq2(y)
            turned.set_seq2(ys)
        direct.set_seq1(x)
        ratio = direct.ratio()
        if " " in y:
            turned.set_seq1(xs)
            ratio = max(ratio, turned.ratio())
        out.append(ratio)
    return pd.Series(out, dtype="float64")


def candidates(values: DataFrame, bases: DataFrame, least: float) -> DataFrame:
    """base, value, n, x, y: pairs of different values whose shared characters allow a ratio of least.

    Bases are a stated, bounded set (one value, or the CAP most frequent), so they are sent to all values."""
    left = with_characters(values.select("value", "n", norm(F.col("value")).alias("x"), merge_key(F.col("value")).alias("xk")).filter("x <> ''"), "x", "a")
    right = with_characters(bases.limit(CAP).select(F.col("value").alias("base"), norm(F.col("value")).alias("y"), merge_key(F.col("value")).alias("yk")).filter("y <> ''"), "y", "b")
    total = F.col("an") + F.col("bn")
    fits = (F.col("xk") != F.col("yk")) & (2 * F.least("an", "bn") >= least * total) & (2 * shared_bound("a", "b") >= least * total)
    return left.join(F.broadcast(right), fits).select("base", "value", "n", "x", "y")


def scored(values: DataFrame, bases: DataFrame, least: float) -> DataFrame:
    """base, value, n and ratio of pairs of different values at or over least. values: value, n. bases: value."""
    pairs = candidates(values, bases, least).sortWithinPartitions("base")
    ratio = _ratio("x", "y", token_sorted(F.col("x")), token_sorted(F.col("y")))
    return pairs.select("base", "value", "n", ratio.alias("ratio")).filter(F.col("ratio") >= least)


def similar_values(values: DataFrame, base: str, least: float = 0.7) -> DataFrame:
    """Values near base: value, n, ratio; nearest, then most frequent first."""
    one = values.sparkSession.createDataFrame([(base,)], "value string")
    found = scored(values, one, min(max(least, 0.0), 1.0)).select("value", "n", F.bround("ratio", 4).alias("ratio"))
    return found.orderBy(F.col("ratio").desc(), F.col("n").desc(), "value").limit(CAP)


def similar_counts(values: DataFrame, most: int = MOST_DISTINCT) -> DataFrame:
    """value and how many others are at 90, 80 and 70 percent, for the CAP most frequent values; no rows of a column with more
    than most different values."""
    every = values.filter(norm(F.col("value")) != "")
    bases = every.orderBy(F.col("n").desc(), "value").limit(CAP if every.count() <= most else 0).select("value")
    pairs = scored(values, bases, 0.7)
    counted = pairs.groupBy(F.col("base").alias("value")).agg(*(F.count_if(F.col("ratio") >= r / 100).alias(f"c{r}") for r in (90, 80, 70)))
    zero = [F.coalesce(f"c{r}", F.lit(0)).cast("long").alias(f"c{r}") for r in (90, 80, 70)]
    return bases.join(counted, "value", "left").select("value", *zero)


CACHE = "value string, c90 bigint, c80 bigint, c70 bigint, digest string, file_id bigint, col string"


def cached_counts(values: DataFrame, folder: str, file_id: int, column: str) -> tuple[DataFrame, bool]:
    """similar_counts of a file's column, and whether a stored scan gave them. values: value, n.

    The table in folder has one partition a file and column, which a new scan replaces alone. A scan holds for a digest of the
    column's values and their numbers, so an edit elsewhere leaves it, and one in the column retires it. A scan without rows is a
    row without a value."""
    spark = values.sparkSession
    counts = values.select(F.lit(column).alias("col"), "value", "n")
    # the digest is over each value as often as it occurs, here with its number in the value's place
    found = values_fingerprint(counts.select("col", F.concat_ws("\x01", F.coalesce("value", F.lit("")), F.col("n").cast("string")).alias("value"))).first()
    digest = found["digest"] if found else ""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    table = spark.read.schema(CACHE).parquet(folder) if held else spark.createDataFrame([], CACHE)
    own = table.filter((F.col("file_id") == file_id) & (F.col("col") == column) & (F.col("digest") == digest))
    hit = bool(own.limit(1).count())
    if not hit:
        marker = spark.createDataFrame([(None, 0, 0, 0)], "value string, c90 bigint, c80 bigint, c70 bigint")
        rows = similar_counts(values).unionByName(marker).withColumns({"digest": F.lit(digest), "file_id": F.lit(file_id).cast("bigint"), "col": F.lit(column)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id", "col").parquet(folder)
        own = spark.read.schema(CACHE).parquet(folder).filter((F.col("file_id") == file_id) & (F.col("col") == column))
    return own.filter("value IS NOT NULL").select("value", "c90", "c80", "c70"), hit
