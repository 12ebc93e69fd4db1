"""Collocations by compressed position bitmaps, extended depth first.

Texts become shards: up to SHARD positions of one language, with an empty position between pieces, so that nothing
extends over a piece's end. In a shard each frequent word has the bitmap of its positions, of which only words of BITS
bits that aren't empty are kept. A phrase's bitmap marks where it ends: shifted by one position (the top bit goes on into
the next word) and ANDed with the bitmaps that meet it there it gives those of its extensions; popcounts are summed over
shards.

First words are counted, then pairs of frequent words, then triples of frequent pairs. Each shard gets back which of its own
words, pairs and triples are frequent over all shards (sums over windows of the shards' rows, so the cost is that of what
shards hold). Then every class of phrases with the same first words goes down to LONGEST words before the next one, along
frequent triples only: no other phrase can be frequent. Counts of phrases are joined to score the cuts; nothing is broadcast by hand or collected.

Defined results: a null text has no words; a null language is `und`; other columns are ignored; rows that repeat count each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, parts, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases of up to so many words are counted length by length, and shards get back which are frequent.
FEEDBACK = 3
#: Positions of a shard, at most 2^22 codes; bits of a bitmap's word; pairs of words and bitmap words compared at once.
SHARD, BITS, AT_ONCE = 1 << 21, 16, 1 << 20
#: Bitmap words of the first words that go down together.
CLASS = 1 << 18
_KIND = np.uint16

#: The bytes that end a piece, and those that part words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in _ENDS else 32 if c in _BLANKS else c for c in range(256))


class _Codes(dict):
    """Codes of words as they come, from 2; 0 is an end of a piece, 1 nothing between two blanks."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


SHARDS = "number bigint, lang string, words array<string>, counts array<bigint>, size bigint, codes binary"


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """Texts as codes of words, by language; words and counts are listed by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 14

        def shard(name: str) -> pa.RecordBatch:
            nonlocal number
            own, found = held.pop(name)
            codes = np.concatenate(found)
            counts = np.bincount(codes, minlength=len(own))[2:]
            words = pa.array([w for w in own][2:], pa.binary()).cast(pa.string())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            packed = pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name]), one(words), one(pa.array(counts, pa.int64())), pa.array([len(codes)], pa.int64()), pa.array([packed], pa.binary())], ["number", "lang", "words", "counts", "size", "codes"])

        for batch in batches:
            for part in parts(batch, 0, 2 << 20):
                by: dict[str, list[bytes]] = {}
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(name, []).append((t or "").encode())
                for name, texts in by.items():
                    own, found = held.setdefault(name, (_Codes(), []))
                    tokens = b"\n".join([b"", *texts]).lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
                    codes = np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens))
                    codes = codes[codes != 1]
                    found.append(codes[(codes > 0) | np.r_[True, codes[:-1] > 0]])
                    if sum(map(len, found)) > size:
                        yield shard(name)
        for name in list(held):
            yield shard(name)

    return docs.select(text, F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, SHARDS)


class Bitmaps:
    """Positions of the words of a shard, numbered 0 to n-1, as (word, block, bits) by word and by block."""

    def __init__(self, words: np.ndarray, n: int) -> None:
        """words: the number at each position, negative where no word counts."""
        at = np.flatnonzero(words >= 0).astype(np.int32)
        own = words[at]
        order = np.argsort(own, kind="stable")
        own, at = own[order], at[order]
        block = at // BITS
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])][: len(own)])
        bits = np.left_shift(1, at % BITS).astype(_KIND)
        self.n = n
        self.word, self.block = own[first], block[first]
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        by = np.argsort(self.block, kind="stable")
        self.by_word, self.by_bits = self.word[by], self.bits[by]
        self.starts = np.searchsorted(self.block[by], np.arange(len(words) // BITS + 3))

    def extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, word, block, bits) of all one-word extensions, in parts: a row for each bitmap word that isn't empty."""
        on, over = bits << _KIND(1), bits >> _KIND(BITS - 1)
        stay, go = np.flatnonzero(on), np.flatnonzero(over)
        node, block, bits = np.r_[node[stay], node[go]], np.r_[block[stay], block[go] + 1], np.r_[on[stay], over[go]]
        begin, met = self.starts[block], self.starts[block + 1] - self.starts[block]
        ends = np.cumsum(met)
        cut = [0, *np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] if len(ends) else 0, AT_ONCE)).tolist(), len(node)]
        for i, j in zip(cut, cut[1:]):
            times = met[i:j]
            row = np.repeat(np.arange(i, j), times)
            place = np.arange(len(row)) + np.repeat(begin[i:j] - (np.cumsum(times) - times), times)
            both = bits[row] & self.by_bits[place]
            hit = np.flatnonzero(both)
            yield node[row[hit]], self.by_word[place[hit]], block[row[hit]], both[hit]

    def all_extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        found = list(self.extended(node, block, bits))
        return tuple(np.concatenate(x) for x in zip(*found))


def _summed(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, their popcounts, the first row of each, the order by key, and each row's key in that order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    first = np.flatnonzero(new)
    counts = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return key[first], counts, order[first], order, np.cumsum(new) - 1


class Steps:
    """Which word may follow which phrase: one may if the last k words are then a known phrase of k words.

    States are the beginnings of known phrases, by length; a step from a beginning of k-1 words leads to the beginning that
    the last k-1 words are, or to none (-1). With k = 1 any word may follow."""

    def __init__(self, known: np.ndarray, n: int) -> None:
        """known: rows of k word numbers below n."""
        k = known.shape[1]
        if k == 1:
            self.start, self.keys, self.next = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
            return
        keys, nexts, levels, offset = [], [], [], 0
        own, at = np.unique(known[:, 0], return_inverse=True)
        levels.append((own, 0))
        self.start = np.full(n, -1)
        self.start[own] = np.arange(len(own))
        for d in range(1, k - 1):
            own, following = np.unique(at * n + known[:, d], return_inverse=True)
            keys.append((own // n + offset) * n + own % n)
            offset += len(levels[-1][0])
            nexts.append(np.arange(len(own)) + offset)
            levels.append((own, offset))
            at = following
        tail = np.zeros(len(known), np.int64)  # the beginning that the phrase without its first word is
        for d, (own, _) in enumerate(levels):
            wanted = known[:, 1] if not d else np.where(tail < 0, -1, tail * n + known[:, d + 1])
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            tail = np.where(own[place] == wanted, place, -1)
        keys.append((at + offset) * n + known[:, -1])
        nexts.append(np.where(tail < 0, -1, tail + offset))
        self.keys, self.next = np.concatenate(keys), np.concatenate(nexts)
        order = np.argsort(self.keys)
        self.keys, self.next = self.keys[order], self.next[order]

    def taken(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of key (state times n, plus the word; negative: none) that are steps, and the states they lead to."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        keep = np.flatnonzero(self.keys[at] == key)
        return keep, self.next[at[keep]]


def classes(word: np.ndarray, most: int = CLASS) -> Iterator[tuple[int, int]]:
    """Stretches of the sorted word with at most so many rows; a word is never parted, so one with more stands alone."""
    ends = np.r_[np.flatnonzero(word[1:] != word[:-1]) + 1, len(word)]
    begin = 0
    while begin < len(word):
        end = int(ends[max(np.searchsorted(ends, begin + most, "right") - 1, np.searchsorted(ends, begin, "right"))])
        yield begin, end
        begin = end


def _opened(row: dict) -> tuple[Bitmaps, np.ndarray]:
    """Bitmaps of a shard's frequent words, numbered in the order of their ids, and the ids."""
    codes = np.frombuffer(pa.decompress(row["codes"], row["size"] * 4, "zstd", asbytes=True), "<i4")
    own, ids = np.array(row["known"], np.int64), np.array(row["ids"], np.int64)
    order = np.argsort(ids)
    number = np.full(max(int(codes.max(initial=0)), int(own.max(initial=0))) + 1, -1, np.int32)
    number[own[order]] = np.arange(len(own))
    return Bitmaps(number[codes], len(own)), ids[order]


def counted(opened: DataFrame, k: int, longest: int) -> DataFrame:
    """How often the phrases of over k, up to longest words that follow known phrases of k words occur in each shard: word ids
    w0, w1, ... (null beyond the phrase) and n with the shard's number. opened has the column phrases (array of structures of k
    ids) where k is over 1."""
    names = ["number", *(f"w{i}" for i in range(longest)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row = one.select(["number", "size", "codes", "known", "ids"]).to_pylist()[0]
                maps, ids = _opened(row)
                n = maps.n
                if k == 1:
                    steps = Steps(np.arange(n)[:, None], n)
                else:
                    held = one.column("phrases").flatten()
                    steps = Steps(np.stack([np.searchsorted(ids, held.field(i).to_numpy(zero_copy_only=False)) for i in range(k)], 1), n)
                # classes of first words: all phrases that start with some words, down to the longest, before the next
                for i, j in classes(maps.word):
                    begin = i + np.flatnonzero(steps.start[maps.word[i:j]] >= 0)
                    node, block, bits = maps.word[begin].astype(np.int64), maps.block[begin], maps.bits[begin]
                    paths, state = np.arange(n)[:, None], steps.start
                    for length in range(2, longest + 1):
                        node, last, block, bits = maps.all_extended(node, block, bits)
                        keep, after = steps.taken(np.where(state[node] < 0, -1, state[node] * n + last))
                        key, counts, first, order, node = _summed(node[keep] * n + last[keep], bits[keep])
                        if not len(key):
                            break
                        paths, state = np.c_[paths[key // n], key % n], after[first]
                        block, bits = block[keep[order]], bits[keep[order]]
                        if length > k:
                            words = [pa.array(ids[paths[:, i]]) if i < length else pa.nulls(len(key), pa.int64()) for i in range(longest)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["number"])), *words, pa.array(counts)], names)

    return opened.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words (id, lang, word, f) and phrases (ids, a) that occur at least so often in a language, and all words' n by lang."""
    held = written(shards(docs, size=size), "shards")
    totals = written(held.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    listed = held.select("number", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    rows = listed.select("number", (F.col("at") + 2).alias("code"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    # a word's id is the shard and the code of its first row
    same = Window.partitionBy("lang", "word")
    named = rows.withColumns({"f": F.sum("n").over(same), "id": F.min(F.col("number") * F.lit(1 << 22) + F.col("code")).over(same)})
    own = written(named.filter(F.col("f") >= least).select("number", "code", "id", "lang", "word", "f"), "words")
    words = own.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.first("f").alias("f"))
    known = own.groupBy("number").agg(F.collect_list(F.struct("code", "id")).alias("k"))
    opened = held.select("number", "size", "codes").join(known, "number")
    opened = opened.select("number", "size", "codes", F.col("k.code").alias("known"), F.col("k.id").alias("ids"))
    found = []
    for k in range(1, min(FEEDBACK, longest)):  # phrases of k + 1 words, with the shards that hold them
        w = [f"w{i}" for i in range(k + 1)]
        total = counted(opened, k, k + 1).withColumn("a", F.sum("n").over(Window.partitionBy(*w))).filter(F.col("a") >= least)
        mine = written(total.select("number", *w, "a"), f"phrases-{k + 1}")
        found.append(mine.groupBy(*w).agg(F.first("a").alias("a")).select(F.array(*w).alias("ids"), "a"))
        held_there = mine.groupBy("number").agg(F.collect_list(F.struct(*w)).alias("phrases"))
        opened = opened.drop("phrases").join(held_there, "number")
    if longest > FEEDBACK:
        w = [f"w{i}" for i in range(longest)]
        more = counted(opened, FEEDBACK, longest).groupBy(*w).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        found.append(more.select(F.filter(F.array(*w), lambda x: x.isNotNull()).alias("ids"), "a"))
    return written(words, "frequent"), written(reduce(DataFrame.unionByName, found), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    words, found, totals = phrases(docs, least, longest, size)
    k = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    cuts = found.select("ids", "a", k.alias("k")).withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    counts = found.unionByName(words.select(F.array("id").alias("ids"), F.col("f").alias("a")))
    of = lambda side, name: counts.select(F.col("ids").alias(side), F.col("a").alias(name))
    langs = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    met = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right").withColumn("first", F.col("ids")[0]).join(langs, "first")
    scored = met.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)"))
    lowest = scored.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what lies in a longer phrase that is as frequent lies in one that is a word longer and as frequent
    ends = F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)")))
    inner = found.filter(F.size("ids") > 2).select(ends.alias("ids"), F.col("a").alias("outer")).groupBy("ids").agg(F.max("outer").alias("outer"))
    own = written(lowest.join(inner, "ids", "left").filter(F.coalesce(F.col("outer") < F.col("a"), F.lit(True))).drop("outer"), "scored")
    spelled = own.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    texts = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("ids", F.array_join("w.word", " ").alias("phrase"))
    rows = own.join(texts, "ids").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    return ranked(rows, top, F.pmod(F.xxhash64("phrase"), F.lit(64)))


def ranked(rows: DataFrame, top: int, salt: Column) -> DataFrame:
    """The first rows of each language; of each of its shares first, so that no task ranks a language alone."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    best = share.filter(F.col("rank") <= top).drop("salt", "rank")
    final = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return final.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS parts FROM f WHERE k > 1 AND a >= 100),
cut AS (SELECT lang, phrase, k, a, j, array_to_string(parts[1:j], ' ') AS left_part, array_to_string(parts[j + 1:], ' ') AS right_part FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, n.n, CAST((CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_part JOIN f y ON y.lang = cut.lang AND y.phrase = right_part JOIN n ON n.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(parts[i:j], ' ') AS phrase, max(a) AS outer_a FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE outer_a IS NULL OR outer_a < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
