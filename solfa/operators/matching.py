"""Which column of a sheet fills which canonical column, for many sheets side by side.

Headers are compared with the canonical names and their synonyms, a constant of a few hundred words that travels as a
literal. What the values look like (headers.type_hits) can outweigh a weak header. Pairs are then dealt best first, in rounds
over all sheets at once."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.headers import header_text, header_tokens
from ..functions.schema import COLUMNS, TYPES
from ..functions.synonyms import SYNONYMS
from ..sources.storage import stored

#: The scores of each kind of match, and the bounds that decide on it.
EXACT, SYNONYM, CONTAINED, MOST_FUZZY = 1.0, 0.96, 0.92, 0.94
LEAST_FUZZY, SURE, LEAST_HITS, STRONG_HEADER = 0.55, 0.85, 0.6, 0.9
_TARGET = "array<struct<target string, position int, kind string, text string, tokens array<string>, phrases array<string>, pool array<string>>>"


def targets(spark: SparkSession) -> Column:
    """The canonical columns with the words of their names and synonyms, as a literal."""
    rows = [(c, i + 1, TYPES[c], j == 0, p) for i, c in enumerate(COLUMNS) for j, p in enumerate([c, *SYNONYMS.get(c, [])])]
    phrases = spark.createDataFrame(rows, "target string, position int, kind string, own boolean, phrase string")
    p, own = F.col("phrase"), F.col("own")
    grouped = phrases.groupBy("target", "position", "kind").agg(
        F.max(F.when(own, header_text(p))).alias("text"), F.max(F.when(own, header_tokens(p))).alias("tokens"),
        F.collect_set(header_text(p)).alias("phrases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(header_tokens(p, True))))).alias("pool"),
    )
    known = [r.asDict() for r in grouped.orderBy("position").collect()]  # thirty rows
    return F.from_json(F.lit(json.dumps(known)), _TARGET)


#: Scores of a word in a pool that a task keeps.
KEPT = 1 << 17


@F.pandas_udf(DoubleType())
def _fuzzy(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How well the words are found in the pool, and the text in the target's, by matching blocks. Words return in many
    headers, so a task keeps their scores; texts are compared only where a text of that length could raise the score."""

    @lru_cache(maxsize=KEPT)
    def best(a: str, pool: tuple[str, ...]) -> float:
        return max(difflib.SequenceMatcher(None, a, b).ratio() for b in pool)

    def score(words, pool, x: str, y: str) -> float:
        found = sum(best(a, pool) for a in words) / len(words) if len(words) and len(pool) else 0.0
        match = difflib.SequenceMatcher(None, x, y)
        whole = match.ratio() if match.real_quick_ratio() > found and match.quick_ratio() > found else 0.0
        return round(min(MOST_FUZZY, max(found, 0.55 * found + 0.45 * whole)), 3)

    for words, pool, text, target in batches:
        yield pd.Series([score(w, tuple(p), x, y) for w, p, x, y in zip(words, pool, text, target)], dtype="float64")


def header_scores(headers: DataFrame, known: Column) -> DataFrame:
    """headers (file, place, header) with target, position, kind, score and method against each canonical column.
    Headers without letters or digits (null too) score nothing and have no rows. Each spelling is scored once, however many
    sheets and places have it."""
    h = F.col("header")
    own = headers.select("header").distinct().select("header", header_text(h).alias("text"), header_tokens(h).alias("every"), header_tokens(h, True).alias("content"))
    pairs = own.filter("text <> ''").select("*", F.explode(known).alias("t"))
    words = F.when(F.size("content") > 0, F.col("content")).otherwise(F.col("every"))
    inside = (F.size("t.tokens") > 0) & (F.size(F.array_except("t.tokens", "content")) == 0)
    method = F.when(F.col("text") == F.col("t.text"), "exact").when(F.array_contains("t.phrases", F.col("text")), "synonym").when(inside, "contained").otherwise("fuzzy")
    pairs = pairs.select("*", method.alias("how"), words.alias("words"))
    plain = F.create_map(*(F.lit(x) for p in {"exact": EXACT, "synonym": SYNONYM, "contained": CONTAINED}.items() for x in p))[F.col("how")]
    fixed = pairs.filter("how <> 'fuzzy'").withColumn("score", plain)
    fuzzy = pairs.filter("how = 'fuzzy'").withColumn("score", _fuzzy("words", "t.pool", "text", "t.text"))
    scored = fixed.unionByName(fuzzy).select("header", "t.target", "t.position", "t.kind", "score", F.when(F.col("how") == "contained", "fuzzy").otherwise(F.col("how")).alias("method"))
    return headers.select("file", "place", "header").join(scored, "header").select("file", "place", *scored.columns)


def with_content(scores: DataFrame, hits: DataFrame | None) -> DataFrame:
    """scores where the share of values of the target's type (hits: file, place, type, fraction) says more than the header."""
    if hits is None:
        return scores.withColumn("header_score", F.col("score"))
    seen = scores.join(hits.filter(F.col("fraction") >= LEAST_HITS).withColumnRenamed("type", "kind"), ["file", "place", "kind"], "left")
    evidence = 0.80 + 0.18 * F.col("fraction")
    better = F.coalesce(evidence > F.col("score"), F.lit(False))
    method = F.when(better & (F.col("score") < STRONG_HEADER), "content").otherwise(F.col("method"))
    return seen.select("file", "place", "header", "target", "position", F.col("score").alias("header_score"), F.when(better, F.round(evidence, 3)).otherwise(F.col("score")).alias("score"), method.alias("method"))


#: The total order in which pairs are dealt; the least is the best.
_RANK = ("against", "place", "position")


def _best(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy("file", key).agg(F.min(F.struct(*_RANK)).alias("best")).select("file", "best.*")


def mutual(pairs: DataFrame) -> DataFrame:
    """file, place and position of the pairs that dealing best pairs first would choose, each header and target of a file once.

    A pair that is the best left for its header and for its target is chosen by that rule whatever comes before it, so each
    round takes all such pairs of all files at once. The best pair left is always one of them, so there are no more rounds
    than targets in a file; no file is gathered in one task."""
    left, chosen, key = pairs.select("file", *_RANK), [], ["file", *_RANK]
    while True:
        left = stored(left, "pairs")
        if left.isEmpty():
            break
        pick = stored(_best(left, "place").join(_best(left, "position"), key).select("file", "place", "position"), "picked")
        chosen.append(pick)
        left = left.join(pick.select("file", "place"), ["file", "place"], "left_anti").join(pick.select("file", "position"), ["file", "position"], "left_anti")
    return reduce(DataFrame.unionByName, chosen, pairs.select("file", "place", "position").limit(0))


def assign(scores: DataFrame) -> DataFrame:
    """file, target, position, header, place, confidence, header_score, method and nth (0: the main source, from 1: further
    ones). Equal scores go to the first header, then the first target. Rows without a file, a score or a place have no part in it;
    of repeated pairs the best counts. Sure leftovers ride along as further sources of their best target that has a main one."""
    pairs = scores.filter((F.col("score") > 0) & F.col("file").isNotNull() & F.col("place").isNotNull() & F.col("position").isNotNull()).withColumn("against", -F.col("score"))
    whole = F.struct("against", "target", "header", "score", "header_score", "method")
    pairs = stored(pairs.groupBy("file", "place", "position").agg(F.min(whole).alias("x")).select("file", "place", "position", "x.*"), "scores")
    main = stored(mutual(pairs.filter((F.col("method") != "fuzzy") | (F.col("score") >= LEAST_FUZZY))), "main")
    more = pairs.filter(F.col("score") >= SURE).join(main.select("file", "position"), ["file", "position"]).join(main.select("file", "place"), ["file", "place"], "left_anti")
    more = _best(more, "place")
    # a window of the further sources of one column of one file
    more = more.select("file", "place", "position", F.row_number().over(Window.partitionBy("file", "position").orderBy(*_RANK)).alias("nth"))
    dealt = main.withColumn("nth", F.lit(0)).unionByName(more)
    return pairs.join(dealt, ["file", "place", "position"]).select("file", "target", "position", "header", "place", F.col("score").alias("confidence"), "header_score", "method", "nth")


def tighten(found: DataFrame, least: float = SURE) -> DataFrame:
    """found without weak fuzzy sources and what rode along with them, and without further sources of unlike headers."""
    weak = found.filter((F.col("nth") == 0) & (F.col("method") == "fuzzy") & (F.col("confidence") < least)).select("file", "target")
    return found.join(weak, ["file", "target"], "left_anti").filter((F.col("nth") == 0) | (F.col("header_score") >= least))


def suggestion(found: DataFrame, known: Column) -> DataFrame:
    """A row for each file and canonical column: header (null if none), confidence, method, needs_review, extras."""
    files = found.select("file").distinct().select("file", F.explode(known).alias("t")).select("file", "t.target", "t.position")
    main = found.filter("nth = 0").select("file", "target", "header", "confidence", "method")
    more = found.filter("nth > 0").groupBy("file", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "header"))), lambda x: x["header"]).alias("extras"))
    rows = files.join(main, ["file", "target"], "left").join(more, ["file", "target"], "left")
    needs = F.coalesce(F.col("confidence") < SURE, F.lit(False))
    return rows.select("file", "position", "target", "header", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("method", F.lit("unmatched")).alias("method"), needs.alias("needs_review"), F.coalesce("extras", F.array().cast("array<string>")).alias("extras"))


def unused(headers: DataFrame, found: DataFrame) -> DataFrame:
    """Headers that fill nothing."""
    return headers.join(found.select("file", "place"), ["file", "place"], "left_anti").select("file", "place", "header")


def summary(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """file and the numbers of headers, matched, unsure and unmatched columns."""
    counts = rows.groupBy("file").agg(F.count_if(F.col("header").isNotNull()).alias("matched"), F.count_if("needs_review").alias("review"), F.count_if(F.col("header").isNull()).alias("unmatched"))
    return headers.groupBy("file").agg(F.count(F.lit(1)).alias("headers")).join(counts, "file", "left").na.fill({"matched": 0, "review": 0, "unmatched": len(COLUMNS)})


def lineage(rows: DataFrame) -> DataFrame:
    """suggestion() rows as file, target, sources (main one first; none if empty) and matched."""
    sources = F.when(F.col("header").isNotNull(), F.concat(F.array("header"), "extras")).otherwise(F.array().cast("array<string>"))
    return rows.select("file", "target", sources.alias("sources"), F.col("header").isNotNull().alias("matched"))
