"""Cross-row flags: exact and possible duplicates of a recording, and barcodes and albums that disagree.

A group in conflict is a class: one row with its size, named by its first row. A flag names its class, and the rows of a class are
members in a table of their own, so what is stored grows with the rows and not with the square of a group. Partners are
joined only for the flags that are shown. Groups meet by joins with their aggregates, which Spark can split when a key is crowded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DEDUP_FIELDS
from ..functions.text import norm
from ..sources.storage import stored

CROSS_TAGS = ("duplicate", "possible_duplicate", "upc_album_mismatch")


def has_real_error(issues: Column) -> Column:
    return F.exists(issues, lambda x: (x["action"] == "error") & ~x["tag"].isin(*CROSS_TAGS))


def _class(rows: DataFrame, key: str, differing: Column, several: Column, tag: str, column: str) -> DataFrame:
    """rows in classes (rows of one key, where `several` holds) with class_id, last, n_rows and differing of their class."""
    groups = rows.groupBy(key).agg(F.min("row_index").alias("class_id"), F.max("row_index").alias("last"), F.count(F.lit(1)).alias("n_rows"), differing.alias("differing"), several.alias("several"))
    met = rows.join(groups.filter("several").drop("several"), key)
    return met.withColumns({"tag": F.lit(tag), "column": F.lit(column)})


def _other() -> Column:
    """'row 5', or 'row 5 and 3 more': another row of the class, and how many there are besides."""
    one = F.when(F.col("row_index") == F.col("class_id"), F.col("last")).otherwise(F.col("class_id")) + 1
    return F.concat(one.cast("string"), F.when(F.col("n_rows") > 2, F.concat(F.lit(" and "), (F.col("n_rows") - 2).cast("string"), F.lit(" more"))).otherwise(""))


_FLAG = ("row_index", "column", "tag", "message", "value", "class_id", "n_rows", "differing")
_MEMBER = ("column", "tag", "class_id", "row_index")


def _flag(met: DataFrame, value: str, message: Column) -> DataFrame:
    return met.filter("not real").withColumns({"message": message, "value": F.col(f"`{value}`")}).select(*_FLAG)


def found(cleaned: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The flags on a cleaned dataset (row_index, column, tag, message, value, class_id, n_rows, differing) and the members of the
    classes that disagree (column, tag, class_id, row_index; rows with an error of their own carry no flag, but are members).
    fields: columns of the dataset. class_id is the first row_index of the class; a class of copies alike (tag duplicate) lists
    no members, as each flag names the row it repeats. Without the columns that a rule needs, the rule gives no rows."""
    used = [f for f in DEDUP_FIELDS if f in fields]
    own = cleaned.select("row_index", has_real_error(F.col("issues")).alias("real"), *(F.coalesce(F.col("values")[f], F.lit("")).alias(f) for f in used))
    own = own.select("*", *(norm(F.col(f"`{f}`")).alias(f"n{i}") for i, f in enumerate(used)))
    own = stored(own.withColumn("sig", F.sha2(F.concat_ws("\x01", *(f"n{i}" for i in range(len(used)))), 256)), "identities")
    n = {f: f"n{i}" for i, f in enumerate(used)}
    spark, rows, flags, members = cleaned.sparkSession, own, [], []
    nothing = F.array().cast("array<string>")
    if "ISRC" in used:
        known = own.filter(F.col(n["ISRC"]) != "")
        first = known.groupBy(n["ISRC"], "sig").agg(F.min("row_index").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
        placed = stored(known.join(first, [n["ISRC"], "sig"]), "placed")
        exact = placed.filter("row_index <> class_id")
        message = F.concat(F.lit("Exact duplicate of row "), (F.col("class_id") + 1).cast("string"), F.lit("."))
        flags.append(exact.select("row_index", F.lit("ISRC").alias("column"), F.lit("duplicate").alias("tag"), message.alias("message"), F.lit("").alias("value"), "class_id", "n_rows", nothing.alias("differing")))
        reps = placed.filter("row_index = class_id").drop("class_id", "n_rows")
        differing = F.array_compact(F.array(*(F.when(F.min(c) != F.max(c), f) for f, c in n.items())))
        met = stored(_class(reps, n["ISRC"], differing, F.count(F.lit(1)) > 1, "possible_duplicate", "ISRC"), "classes")
        message = F.concat(
            F.lit("Same ISRC as row "), _other(), F.lit(" but "), F.array_join("differing", ", "),
            F.when(F.size("differing") == 1, " differs").otherwise(" differ"), F.lit(". Compare and confirm it isn't a duplicate."),
        )
        flags.append(_flag(met, "ISRC", message))
        members.append(met)
        rows = own.join(exact.select("row_index"), "row_index", "left_anti")
    if "UPC" in used and "Album Name" in used:
        both = stored(rows.filter((F.col(n["UPC"]) != "") & (F.col(n["Album Name"]) != "")), "both")
        one, met = _mismatch(both, n, "UPC", "Album Name", "shares UPC but the Album Name differs")
        # a flag of the first pass is an error of its row in the second
        still = both.join(one.select("row_index").withColumn("flagged", F.lit(True)), "row_index", "left").withColumn("real", F.col("real") | F.coalesce("flagged", F.lit(False))).drop("flagged")
        two, more = _mismatch(still, n, "Album Name", "UPC", "shares Album Name but the UPC differs")
        flags, members = [*flags, one, two], [*members, met, more]
    if not flags:
        return spark.createDataFrame([], _FLAG_SCHEMA), spark.createDataFrame([], _MEMBER_SCHEMA)
    return reduce(DataFrame.unionByName, flags), reduce(DataFrame.unionByName, (m.select(*_MEMBER) for m in members)) if members else spark.createDataFrame([], _MEMBER_SCHEMA)


_FLAG_SCHEMA = "row_index long, column string, tag string, message string, value string, class_id long, n_rows long, differing array<string>"
_MEMBER_SCHEMA = "column string, tag string, class_id long, row_index long"


def _mismatch(rows: DataFrame, n: dict[str, str], key: str, other: str, reason: str) -> tuple[DataFrame, DataFrame]:
    several = F.min(n[other]) != F.max(n[other])
    met = stored(_class(rows, n[key], F.array(F.lit(other)), several, "upc_album_mismatch", other), "mismatch")
    message = F.concat(F.lit("Row "), _other(), F.lit(f" {reason} (got “"), F.col(f"`{other}`"), F.lit("”). Please reconcile."))
    return _flag(met, other, message), met


def flags(cleaned: DataFrame, fields: list[str]) -> DataFrame:
    return found(cleaned, fields)[0]


def classes(flags: DataFrame) -> DataFrame:
    """column, tag, class_id, n_rows, differing and n_flags of each class."""
    return flags.groupBy("column", "tag", "class_id").agg(F.first("n_rows").alias("n_rows"), F.first("differing").alias("differing"), F.count(F.lit(1)).alias("n_flags"))


def partners(shown: DataFrame, members: DataFrame) -> DataFrame:
    """row_index, column, tag and partner (a row number from 1) of the flags that are shown: a row for each other member."""
    key = ["column", "tag", "class_id"]
    met = shown.select("row_index", *key).join(members.withColumnRenamed("row_index", "other"), key).filter("other <> row_index")
    return met.select("row_index", "column", "tag", (F.col("other") + 1).alias("partner"))


def related(flags: DataFrame, members: DataFrame) -> DataFrame:
    """flags with related: the row numbers (from 1) of all other rows of the flag's class, joined by commas; none for a copy
    alike, which names the row it repeats. A class travels as one list of its row numbers, and the text of a flag is as long
    as its class is large."""
    key = ["column", "tag", "class_id"]
    lists = members.groupBy(*key).agg(F.sort_array(F.collect_list("row_index")).alias("members"))
    met = flags.join(lists, key, "left")
    others = F.transform(F.filter("members", lambda m: m != F.col("row_index")), lambda m: (m + 1).cast("string"))
    return met.select(*flags.columns, F.coalesce(F.array_join(others, ","), F.lit("")).alias("related"))


def mark_duplicates(cleaned: DataFrame, fields: list[str]) -> DataFrame:
    """cleaned with its cross-row issues renewed. An issue names one other row and how many more; partners() has them all."""
    none = F.lit(None).cast("array<bigint>").alias("related_rows")
    new = F.struct("column", F.lit("error").alias("action"), "tag", "message", "value", F.lit("").alias("original"), F.lit(False).alias("cosmetic"), none)
    lists = flags(cleaned, fields).groupBy("row_index").agg(F.sort_array(F.collect_list(new)).alias("found"))  # three at most a row
    kept = F.filter("issues", lambda x: ~F.coalesce(x["tag"].isin(*CROSS_TAGS), F.lit(False)))
    return cleaned.join(lists, "row_index", "left").select("row_index", "values", F.concat(kept, F.coalesce("found", F.array_except("issues", "issues"))).alias("issues"))
