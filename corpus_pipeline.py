"""From raw documents to packed training sequences: language ID, line dedup, near-duplicates, repeated passages, packing.

Each stage takes all that the one before kept, stored as Parquet; its decisions take effect on the documents it returns.
Defined results: an empty table goes through as empty; rows without a doc_id pass the near-duplicate stage; a
document whose lines or passages are all removed stays as an empty text until near-duplicates are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solfa.llm.graph import components
from solfa.llm.language import REJECT, identify, trained
from solfa.llm.line_dedup import dedup
from solfa.llm.near_copies import near_links
from solfa.llm.packing import pack, pieces
from solfa.llm.shared import documents, written
from solfa.llm.suffix_dedup import WORDS, kept_text, remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or that no language fits well, go."""
    found = identify(docs, trained(docs), keys=COLUMNS)
    known = (F.col("lang_pred") != "und") & (F.col("score") >= REJECT)
    return found.filter(known).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the earliest of each class of similar lines."""
    return _documents(dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have similarity 0.8 or more: that of the least
    doc_id, of equal ones that of the least hash of its text. Texts without words are one component."""
    words = F.coalesce("text", F.lit("")).rlike(r"\S")
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("_id", F.when(words, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    roots = components(near_links(named.filter(words).select(F.col("_id").alias("id"), F.col("text").alias("line"))))
    rows = written(named.select("doc_id", "_id").distinct(), "rows")
    classes = rows.join(roots, F.col("_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_id"))
    stay = classes.groupBy("root").agg(F.min(F.struct("doc_id", "_id")).alias("first")).select("first.*")
    kept = named.join(stay, ["doc_id", "_id"], "left_semi").dropDuplicates(["doc_id", "_id"])
    return kept.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that repeat, whatever their bytes."""
    return _documents(remove_repeats(docs, WORDS).withColumn("text", kept_text(F.col("kept"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    import public_tokenizers as vocabulary

    return pack(written(pieces(docs, vocabulary.path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL has no trained network, MinHash signatures or differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
