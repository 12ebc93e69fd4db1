"""Fuzzy line dedup by MinHash, with DataFrame functions only: one line of each component stays, the earliest.

A line's set is its character shingles of WIDTH. Its signature holds minima of its shingles' hashes under seeds; a
band's key hashes ROWS of them. Lines of many different words sign only shingles that start a word (of WORD_WIDTH, or
unrelated lines would share them), lines of few all shingles, and lines between the two bounds both ways, so that lines
of similar length share a way. Scattered edits break more of the wider shingles (about 0.71 of them are common where
0.8 of the verified ones are), so they have WORD_BANDS bands, the others BANDS.

Lines that share a key are compared by exact Jaccard similarity over all shingles: all pairs where up to CROWD lines
share it; beyond, each with the most central line of the key. A crowded key is settled once all its lines are in the
central line's component. Of any other, each line is described by its differences from the central line (shingles that
it has more or lacks), which tell the similarity of any two of them exactly. All its lines are compared with up to
CENTRES of those that are left, then all pairs of different components of which one is left, dealt in cells of BLOCK
lines by BLOCK: a few machine words of each (bits of its differences) refute most pairs, and only links come out.
So no pair that shares a key is dropped. Links then go to distributed union-find.

Each different line moves once to be signed, copies are united before; then only numbers are shuffled to find candidates.
Texts of candidate lines are picked by a sieve of fixed size before they are shuffled to be compared, and each
document's text moves once, to meet its kept positions.

Defined results: lines are split at newlines; a blank line is left where it is; a null text stays null with no lines;
an empty text has one blank line; the earliest line is that of the least doc_id (null first), then position; rows
that repeat a doc_id share its judgement; lines under WIDTH characters match exactly or not at all. Should
two different lines ever have the same 64-bit key, which a second hash tells, all their copies stay.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import documents, packed, written

WIDTH, WORD_WIDTH, THRESHOLD = 8, 12, 0.8
BANDS, WORD_BANDS, ROWS = 8, 14, 3
FEW, MANY = 8, 16
CROWD, CENTRES, BLOCK = 32, 16, 1024
SIEVE_BITS = 1 << 22
Kernel = Callable[..., Column | DataFrame]
_seed = random.Random(11)
SEEDS = [_seed.getrandbits(64) - (1 << 63) for _ in range(WORD_BANDS * ROWS)]


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line and its key of every line that isn't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.filter(F.trim("line") != "").withColumn("id", F.xxhash64("line"))


def shingles(line: Column | str) -> Column:
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1))


def word_shingles(line: Column | str) -> Column:
    """Shingles of WORD_WIDTH that start a word."""
    return F.regexp_extract_all(F.concat(F.lit(" "), line), F.lit(f"(?s)\\s(?=(\\S.{{{WORD_WIDTH - 1}}}))"), F.lit(1))


def signed(lines: DataFrame, *own: str) -> DataFrame:
    """id, the columns own and keys (an array of the keys of the way's bands) of each different line; a line without shingles
    has one row without keys."""
    n, none = F.size(F.array_distinct(F.split("line", " "))), F.array().cast("array<string>")
    sets = F.concat(F.when(n >= FEW, word_shingles("line")).otherwise(none), F.when(n <= MANY, shingles("line")).otherwise(none))
    # outer, or Spark works the arrays out once more to leave out empty ones; the width of a shingle tells its way
    cut = lines.select("id", *own, F.explode_outer(sets).alias("s"))
    way = F.when(F.col("s").isNull(), 2).when(F.char_length("s") == WORD_WIDTH, 0).otherwise(1)
    hashed = cut.select("id", *own, way.alias("way"), F.shiftright(F.xxhash64("s"), 32).cast("int").alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(s >> 32))).alias(f"m{i}") for i, s in enumerate(SEEDS)]
    keys = [F.xxhash64("way", F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(WORD_BANDS)]
    band = F.when(F.col("way") == 0, F.array(*keys)).when(F.col("way") == 1, F.array(*keys[:BANDS])).otherwise(F.array().cast("array<bigint>"))
    return hashed.groupBy("id", *own, "way").agg(*minima).select("id", *own, band.alias("keys"))


def keyed(rows: DataFrame) -> DataFrame:
    """id and key, a row for each band."""
    return rows.select("id", F.explode("keys").alias("key"))


def sieve(keys: DataFrame, column: str, test: Column) -> Column:
    """A condition that holds wherever test is among keys' values, and seldom elsewhere while they are few.
    It is a bitmap of fixed size, however many keys there are."""
    place = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    word = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))")
    rows = keys.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).cast("int").alias("at")).agg(word.alias("word")).collect()
    words = [0] * (SIEVE_BITS // 64)
    for row in rows:
        words[row["at"]] = row["word"]
    own = F.pmod(F.xxhash64(test), F.lit(SIEVE_BITS))
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # a constant, folded once
    return F.getbit(F.element_at(bits, (F.floor(own / 64) + 1).cast("int")), (own % 64).cast("int")) == 1


def similar_links(lines: DataFrame, signatures: DataFrame, threshold: float = THRESHOLD, sets: Kernel | None = None, more: DataFrame | None = None) -> DataFrame:
    """a, b: keys of lines whose Jaccard similarity reaches threshold. All lines of a key that do are linked,
    if not by a pair of their own then through others. signatures is the stored result of signed() or the like, sets
    stands for hashed(); more has pairs (a, b) to compare besides."""
    sets = sets or hashed
    rows = keyed(signatures)
    shared = written(rows.groupBy("key").count().filter("count > 1"), "shared")
    met = written(rows.filter(sieve(shared, "key", F.col("key"))).join(shared, "key"), "met")
    small, large = met.filter(F.col("count") <= CROWD), met.filter(F.col("count") > CROWD)
    pairs = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b")
    stars = written(_stars(large), "stars")
    pairs = pairs if more is None else pairs.unionByName(_ordered(more))
    near = written(similar(lines, written(pairs.unionByName(_ordered(stars)).distinct(), "pairs"), threshold, sets), "near")
    return near if stars.isEmpty() else near.unionByName(_crowded_links(lines, stars, near, threshold, sets))


def _stars(large: DataFrame) -> DataFrame:
    """a, b: each line of a key (key, id, count) and the key's most central line, whose keys are shared most."""
    central = large.groupBy("id").agg(F.sum("count").alias("weight"))
    best = large.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("best"))
    stars = large.join(best.select("key", F.col("best.id").alias("b")), "key").filter("id <> b")
    return stars.select(F.col("id").alias("a"), "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _crowded_links(lines: DataFrame, stars: DataFrame, near: DataFrame, threshold: float, sets: Kernel) -> DataFrame:
    """a, b: links that the lines of stars (line a, central line b, compared) need besides near to be linked as all
    pairs of the lines of one key would."""
    crowd = written(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "crowd")
    ends = [crowd.select(F.col("id").alias(x)) for x in ("a", "b")]
    known = written(near.join(ends[0], "a", "left_semi").join(ends[1], "b", "left_semi").select("a", "b"), "known")
    placed = written(_placed(crowd, known), "placed")
    roots = [placed.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    own = written(stars.join(roots[0], "a").join(roots[1], "b"), "own")
    unsettled = own.filter("root_a <> root_b").select("b").distinct()
    held = written(own.join(unsettled, "b", "left_semi").select("a", "b"), "held")
    if held.isEmpty():
        return near.limit(0)
    wanted = written(held.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = lines.filter(sieve(wanted, "id", F.col("id"))).groupBy("id").agg(F.min("line").alias("line")).join(wanted, "id", "left_semi")
    apart = written(_differences(written(texts, "texts"), held, sets), "apart")
    rows = apart.join(placed, "id").join(roots[1], F.col("centre") == F.col("b")).withColumn("open", F.col("root") != F.col("root_b")).drop("b", "root_b")
    # some of the lines that are left, as centres of their own
    left = rows.filter("open").withColumn("place", F.pmod(F.xxhash64("id", "centre"), F.lit(CENTRES)))
    picked = left.groupBy("centre", "place").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "centre")), "id").alias("pick"))
    first = written(_compared(rows, picked.select("centre", "pick.*"), ["centre"], threshold), "near")
    placed = written(_placed(crowd, written(known.unionByName(first), "known")), "placed")
    roots = placed.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    rows = apart.join(placed, "id").join(roots, F.col("centre") == F.col("b")).withColumn("open", F.col("root") != F.col("root_b")).drop("b", "root_b")
    sizes = rows.groupBy("centre").agg(F.count(F.lit(1)).alias("size")).join(rows.filter("open").select("centre").distinct(), "centre", "left_semi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = written(rows, "rows").join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("low"), F.greatest(F.col("block"), j).alias("high")))
    dealt = dealt.select(*rows.columns, "block", F.explode_outer(cells).alias("cell")).select("*", "cell.low", "cell.high").drop("cell")
    sides = dealt.filter("block = low").drop("block"), dealt.filter("block = high").drop("block")
    return first.unionByName(written(_compared(*sides, ["centre", "low", "high"], threshold), "near"))


def _placed(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """id and root of the lines of crowd."""
    return crowd.join(components(links), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def _differences(texts: DataFrame, stars: DataFrame, sets: Kernel) -> DataFrame:
    """centre, id, n (the size of its set), own (its differences from the centre's set) and bits of them, of each line a
    and of the central line b itself."""
    stars = stars.unionByName(stars.select(F.col("b").alias("a"), "b").distinct())
    both = stars.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = both.select("a", "b", sets("x").alias("x"), sets("y").alias("y"))
    own = both.select(F.col("b").alias("centre"), F.col("a").alias("id"), F.size("x").alias("n"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("own"))
    bit = lambda i: F.aggregate("own", F.lit(0).cast("long"), lambda all_, t: F.when(F.pmod(t, F.lit(256)).between(64 * i, 64 * i + 63), all_.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(64)).cast("int")))).otherwise(all_))
    return own.select("*", *(bit(i).alias(f"bits{i}") for i in range(4)))


def _compared(left: DataFrame, right: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """a, b: pairs of rows of _differences() with root and open that are similar, of different components, one open."""
    x, y = left.select(*on, *(F.col(c).alias(f"{c}_x") for c in left.columns if c not in on)), right.select(*on, *(F.col(c).alias(f"{c}_y") for c in right.columns if c not in on))
    total, apart = F.col("n_x") + F.col("n_y"), F.size("own_x") + F.size("own_y")
    lacks = lambda p, q: sum((F.bit_count(F.col(f"bits{i}_{p}").bitwiseAND(F.bitwise_not(f"bits{i}_{q}"))) for i in range(4)), F.lit(0))
    similar_ = lambda common: (total - apart + 2 * common) / 2 >= threshold * (total - (total - apart + 2 * common) / 2)
    likely = similar_(F.least(F.size("own_x") - lacks("x", "y"), F.size("own_y") - lacks("y", "x")))
    met = x.join(y, on).filter((F.col("root_x") != F.col("root_y")) & (F.col("open_x") | F.col("open_y")) & likely & similar_(F.size(F.array_intersect("own_x", "own_y"))))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def hashed(line: Column | str) -> Column:
    """The set of hashed shingles. Those of an ASCII line are cut by their bytes, which is as exact and cheaper."""
    line = F.col(line) if isinstance(line, str) else line
    plain = (F.octet_length(line) == F.char_length(line)) & (F.octet_length(line) >= WIDTH)
    cut = lambda raw: F.transform(F.sequence(F.lit(1), F.octet_length(raw) - (WIDTH - 1)), lambda i: F.xxhash64(F.substring(raw, i, F.lit(WIDTH))))
    found = F.when(plain, F.get(F.transform(F.array(line.cast("binary")), cut), F.lit(0))).otherwise(F.transform(shingles(line), lambda x: F.xxhash64(x)))
    return F.array_distinct(found)


def similar(lines: DataFrame, pairs: DataFrame, threshold: float, own: Kernel) -> DataFrame:
    """Those pairs (a, b, stored) whose lines' shingles have at least this Jaccard similarity."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = lines.filter(sieve(wanted, "id", F.col("id"))).groupBy("id").agg(F.min("line").alias("line")).join(wanted, "id", "left_semi")
    texts = written(texts, "texts")
    # lines move as text, which is an eighth of their hashed shingles
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    sets = both.select("a", "b", own("x").alias("x"), own("y").alias("y"))
    least, most = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    likely = sets.filter(least >= threshold * most)  # else even one set within the other falls short
    common = likely.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return common.filter(F.col("common") >= threshold * (F.col("total") - F.col("common"))).select("a", "b")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with text cut to its kept lines, n_lines and n_removed (lines that aren't blank; columns that had those
    names are replaced)."""
    lines = split_lines(docs.select("doc_id", "text"))
    second = F.xxhash64("line", F.lit(1))
    once = lines.groupBy("id").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.min(second).alias("low"), F.max(second).alias("high"), F.min("line").alias("line"))
    # lines dealt by id stay where they are to be signed, so their minima aren't shuffled
    signatures = written(signed(once, "first", "low", "high"), "signatures")
    first = written(signatures.select("id", "first", "low", "high").distinct(), "lines")
    roots = components(similar_links(lines, signatures.select("id", "keys"), threshold))
    # written, so that Spark deals both sides anew and can split a large component
    classes = first.filter("low = high").join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("id"), "first")
    kept = classes.groupBy("id").agg(F.min("first").alias("first")).select("first.doc_id", "first.pos")
    unsure = first.filter("low <> high").select("id")
    kept = kept.unionByName(lines.join(unsure, "id").select("doc_id", "pos")) if not unsure.isEmpty() else kept
    kept = kept.distinct().groupBy("doc_id").agg(F.collect_list("pos").alias("_kept")).withColumnRenamed("doc_id", "_doc")
    own = packed(docs, "text", "n_lines", "n_removed").select("doc_id", "text", "rest")
    whole = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    parts = F.split("text", "\n", -1)
    blank = F.filter(F.sequence(F.lit(0), F.size("_parts") - 1), lambda i: F.trim(F.element_at("_parts", i + 1)) == "")
    stay = F.array_sort(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), F.col("_blank")))
    out = whole.withColumn("_parts", parts).withColumn("_blank", blank).withColumn("_stay", stay)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_parts") - F.size("_blank"))
    gone = F.when(F.col("text").isNull(), 0).otherwise(F.size("_parts") - F.size("_stay"))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform("_stay", lambda i: F.element_at("_parts", i + 1)), "\n"))
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_removed", gone.cast("long")).withColumn("text", text)
    return out.select("rest.*", "text", "n_lines", "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and the digest of what stays."""
    done = dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
