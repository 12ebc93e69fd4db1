"""Works with writers side by side to one row for each writer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ride on a work's first writer.
HEAD = ("title", "aka_title", "aka_type", "pub_number", "pub_name", "pub_ipi", "collection_share", "rec_title", "rec_artist", "rec_isrc", "rec_label")
#: Header spellings, letters and digits only.
WRITERS = {"C": r"(COMPOSER|COMPOSERNAME|MUSICCOMPOSER|MUSICDIRECTOR)\d*", "A": r"(LYRICIST|LYRICISTNAME|LYRICWRITER|LYRICS|AUTHOR|WRITER)\d*"}
SINGERS = r"(SINGER|SINGERNAME|VOCALIST|PERFORMER|ARTIST|ARTISTNAME)\d*"
IPIS = r"(CAE|CAENO|CAENUMBER|CAEIPI|IPI|IPINO|IPINUMBER)\d*"


def layout(headers: list[str]) -> dict:
    """Places of writers with their identifiers, and of singers. An identifier is the first such column right of its
    writer, before the next writer or singer."""
    plain = [re.sub("[^A-Z0-9]", "", h.upper()) for h in headers]
    marks = [(i, role) for i, h in enumerate(plain) for role, p in WRITERS.items() if re.fullmatch(p, h)]
    singers = [i for i, h in enumerate(plain) if re.fullmatch(SINGERS, h)]
    stops = sorted([i for i, _ in marks] + singers) + [len(headers)]
    pairs = []
    for i, role in marks:
        end = next(s for s in stops if s > i)
        pairs.append((role, i, next((j for j in range(i + 1, end) if re.fullmatch(IPIS, plain[j])), None)))
    return {"writers": sorted(pairs, key=lambda x: (list(WRITERS).index(x[0]), x[1])), "singers": singers}


def without_id(name: Column) -> tuple[Column, Column]:
    """A name and the identifier of five digits or more stuck to its end ('' if none)."""
    s = F.trim(name)
    pattern = "^(.*?\\S)\\s*[-–—]\\s*(\\d{5,})$"
    found = s.rlike(pattern)
    return F.when(found, F.regexp_extract(s, pattern, 1)).otherwise(s), F.when(found, F.regexp_extract(s, pattern, 2)).otherwise("")


def split_name(name: Column) -> tuple[Column, Column]:
    """(last, first): the first word and the rest; a single word is both."""
    words = F.filter(F.split(F.trim(name), "\\s+"), lambda x: x != "")
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " ")
    return F.when(F.size(words) == 1, first).otherwise(rest), first


def writer_rows(works: DataFrame, writers: list[tuple[str, str, str | None]], head: dict[str, Column]) -> DataFrame:
    """work_seq, writer_seq, HEAD (on the first writer only), last, first, ipi, role.

    works: work_seq and text columns. writers: (role, name column, identifier column), composers first. One person in
    both roles of a work is one writer with role CA; its first mention keeps its identifier, or takes that of the other role."""
    entries = []
    for place, (role, name, ipi) in enumerate(writers):
        plain, stuck = without_id(F.col(name))
        own = F.trim(F.col(ipi)) if ipi else F.lit("")
        entries.append(F.struct(F.lit(place).alias("place"), F.lit(role).alias("role"), plain.alias("name"), F.when(own != "", own).otherwise(stuck).alias("ipi")))
    rows = works.select("work_seq", *(c.alias(a) for a, c in head.items()), F.posexplode(F.filter(F.array(*entries), lambda e: e["name"] != "")).alias("at", "w"))
    # a work's first writer is the first of its row, so the others travel without the work's columns; one exchange serves all windows
    rows = rows.select("work_seq", *(F.when(F.col("at") == 0, F.col(a)).otherwise("").alias(a) for a in head), "w.*").repartition("work_seq").withColumn("person", F.lower(F.trim(F.regexp_replace("name", "(?U)\\s+", " "))))
    # a work has as many rows here as writer columns, so its windows are small
    person = Window.partitionBy("work_seq", "person").orderBy("place")
    every = person.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = F.size(F.collect_set("role").over(every)) > 1
    lead = F.first("role").over(every)
    # the first mention takes in those of the other role; more mentions in its own role stay rows
    rows = rows.withColumn("both", both).withColumn("nth", F.row_number().over(person)).withColumn("lead", lead)
    # its own identifier, else that of a mention which it takes in
    own = (F.col("ipi") != "") & ((F.col("nth") == 1) | (F.col("role") != F.col("lead")))
    rows = rows.withColumn("given", F.first(F.when(own, F.col("ipi")), ignorenulls=True).over(every))
    rows = rows.filter(~F.col("both") | (F.col("nth") == 1) | (F.col("role") == F.col("lead")))
    merged = F.col("both") & (F.col("nth") == 1)
    rows = rows.withColumn("ipi", F.when(merged, F.coalesce("given", F.lit(""))).otherwise(F.col("ipi"))).withColumn("role", F.when(merged, "CA").otherwise(F.col("role")))
    rows = rows.withColumn("writer_seq", F.row_number().over(Window.partitionBy("work_seq").orderBy("place")))
    last, first = split_name(F.col("name"))
    heads = [F.when(F.col("writer_seq") == 1, F.col(a)).otherwise("").alias(a) for a in head]
    return rows.select("work_seq", "writer_seq", *heads, last.alias("last"), first.alias("first"), "ipi", "role")
