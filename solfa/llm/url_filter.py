"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Keys are host || path-prefix. Level 0 is a Bloom filter of the listed keys; level 1 holds the keys of the corpus's
whole universe that pass level 0 without being listed; level 2 the listed keys that pass level 1; and so on until
no key passes wrongly. Membership of any key of the universe is then exact: the first level that a key misses
decides. A lookup is a few hashes and bit tests on constants, so judging the corpus needs no join and no shuffle.

The bits are constants of the plan; their size is bounded by MAX_LISTED keys (listed) and by the false positives
they leave, which level 0's rate keeps near the number of listed keys. A longer list raises ValueError.

Defined results: a null url, or one without "://", has empty host and path and no rule; an empty table gives no rows;
repeated rows are judged each; if a key is listed with both verdicts, block wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, written

MAX_LISTED = 100_000
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule with one of these path lengths could have to fit: host suffixes by path prefixes."""
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int] = field(default_factory=list)

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def fill(self, keys: DataFrame) -> None:
        """Set the bits of the column key; only words with a bit come to the driver."""
        place = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("place"))
        word = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("word")
        self.words = [0] * (-(-self.bits // 64))
        for row in place.groupBy(F.floor(F.col("place") / 64).cast("int").alias("at")).agg(word).collect():
            self.words[row["at"]] = row["word"]

    def has(self, key: Column) -> Column:
        words = F.array(*(F.lit(w).cast("long") for w in self.words))
        out = F.lit(True)
        for place in self.places(key):
            word = F.element_at(words, (F.floor(place / 64) + 1).cast("int"))
            out = out & (F.getbit(word, (place % 64).cast("int")) == 1)
        return out


def sized(n: int, rate: float, seed: int) -> Level:
    """A level for n keys with this rate of false positives."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return Level(bits, max(1, round(bits / max(n, 1) * math.log(2)) if bits > 64 else 3), seed)


class Cascade:
    """Exact membership in listed keys, for keys of universe. Both have one column, key."""

    def __init__(self, listed: DataFrame, universe: DataFrame, universe_size: int) -> None:
        n = listed.count()
        if n > MAX_LISTED:
            raise ValueError(f"{n} listed keys; the bound is {MAX_LISTED}")
        self.levels: list[Level] = []
        if not n:
            return
        rate = min(0.5, max(1e-6, n / max(1, universe_size) * math.sqrt(0.5)))
        level = sized(n, rate, 0)
        level.fill(listed)
        self.levels.append(level)
        # only keys that pass level 0 are compared with the list, which its bound lets Spark broadcast
        wrong = universe.filter(level.has(F.col("key"))).distinct().join(F.broadcast(listed), "key", "left_anti")
        inside, outside = listed, written(wrong, "cascade")
        while (left := outside.count()):
            level = sized(left, 0.5, 1000 * len(self.levels))
            level.fill(outside)
            self.levels.append(level)
            inside, outside = outside, written(inside.filter(level.has(F.col("key"))), "cascade")

    def has(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), i % 2 == 1).otherwise(out)
        return out


def _hits(cascade: Cascade, verdict: str) -> Column:
    hits = F.filter(F.col("_keys"), cascade.has)
    return F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (in place of columns that had those names) by the longest rule that
    fits; default where none does."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, path, _ in rules})
    host, path = host_and_path(F.col("url"))
    own = packed(pages, "host", "path", "rule", "verdict").select("rest", "url")
    rows = own.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    keyed = rows.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    size = keyed.agg(F.approx_count_distinct("key")).first()[0]
    keys, found = candidate_keys(F.col("host"), F.col("path"), lengths), []
    for verdict in ("allow", "block"):
        listed = spark.createDataFrame([(h + p,) for h, p, v in rules if v == verdict] or [], "key string").distinct()
        cascade = Cascade(listed, keyed, size)
        found.append(_hits(cascade, verdict))
    best = F.array_max(F.concat(*found))
    return (
        rows.withColumn("_keys", keys)
        .withColumn("_best", best)
        .withColumn("rule", F.col("_best.key"))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default)))
        .select("rest.*", "host", "path", "rule", "verdict")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
