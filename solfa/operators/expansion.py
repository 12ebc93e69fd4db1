"""An expansion of works to writers' rows, checked against the works it was made of.

What each work should have become is worked out anew from its cells, as arrays of one work, not by the windows that made the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import judged
from .pagination import LIMIT
from .writers import split_name, without_id

#: Fields of a written row that no source fills.
UNFILLED = ("song_code", "members_id", "iswc", "admin_number", "admin_name", "admin_ipi")
_STUCK = "^(.*?\\S)\\s*[-–—]\\s*(\\d{5,})$"


def _mentions(writers: list[tuple[str, str, str | None]]) -> Column:
    """place, role, name, ipi, person and stuck (its cell had an identifier in the name) of each filled writer cell of a work."""
    out = []
    for place, (role, name, ipi) in enumerate(writers):
        plain, attached = without_id(F.coalesce(F.col(name), F.lit("")))
        own = F.coalesce(F.trim(F.col(ipi)), F.lit("")) if ipi else F.lit("")
        person = F.lower(F.trim(F.regexp_replace(plain, "(?U)\\s+", " ")))
        out.append(F.struct(F.lit(place).alias("place"), F.lit(role).alias("role"), plain.alias("name"), F.when(own != "", own).otherwise(attached).alias("ipi"), person.alias("person"), (attached != "").alias("stuck")))
    return F.filter(F.array(*out), lambda x: x["name"] != "")


def compared(works: DataFrame, writers: list[tuple[str, str, str | None]], head: dict[str, Column], rows: DataFrame, placed: DataFrame) -> DataFrame:
    """A row for each work of works (work_seq is its key) and of rows (writer_rows of works; placed: their parts): what its cells
    ask for (due) and what was written (back), both in order, and what checks need. Nulls in writer cells are blank."""
    same = lambda x, y: x["person"] == y["person"]
    want = works.select("work_seq", F.struct(*(c.alias(a) for a, c in head.items())).alias("head"), _mentions(writers).alias("m"), F.lit(True).alias("in_works"))
    led = F.transform("m", lambda x: F.struct(*(x[f].alias(f) for f in ("place", "role", "name", "ipi", "person", "stuck")), F.filter("m", lambda y: same(x, y))[0].alias("lead")))
    want = want.withColumn("m", led)
    taken = lambda x: x["role"] != x["lead"]["role"]
    # a person's identifier is the first one of the lead mention and those that it takes in
    held = F.transform("m", lambda x: F.struct(
        *(x[f].alias(f) for f in ("role", "name", "ipi", "person", "stuck")), taken(x).alias("taken"),
        ((x["place"] == x["lead"]["place"]) & F.exists("m", lambda y: same(x, y) & taken(y))).alias("merged"),
        F.coalesce(F.get(F.filter("m", lambda y: same(x, y) & (y["ipi"] != "") & (taken(y) | (y["place"] == x["lead"]["place"]))), F.lit(0))["ipi"], F.lit("")).alias("given"),
    ))
    want = want.withColumn("m", held).withColumn("kept", F.filter("m", lambda x: ~x["taken"]))
    label = F.coalesce(F.nullif(F.col("head")["title"], F.lit("")), F.lit("untitled"))
    clashes = F.transform(F.filter("m", lambda x: x["taken"] & (x["ipi"] != "") & (x["ipi"] != x["given"])), lambda x: F.concat(x["name"], F.lit(" ("), label, F.lit(")")))
    line = lambda x: F.struct(*(c.alias(a) for a, c in zip(("last", "first"), split_name(x["name"]))), F.when(x["merged"], x["given"]).otherwise(x["ipi"]).alias("ipi"), F.when(x["merged"], "CA").otherwise(x["role"]).alias("role"))
    want = want.select("work_seq", "head", "in_works", label.alias("label"), clashes.alias("clashes"), F.transform("kept", line).alias("due"),
        F.size("m").alias("cells"), F.size(F.filter("kept", lambda x: x["stuck"])).alias("stuck"))
    unfilled = reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in UNFILLED if c in rows.columns), F.lit(True))
    written = F.struct("writer_seq", F.struct(*head).alias("head"), F.struct("last", "first", "ipi", "role").alias("line"), unfilled.alias("unfilled"))
    back = rows.groupBy("work_seq").agg(F.sort_array(F.collect_list(written)).alias("back"))
    spread = placed.groupBy("work_seq").agg(F.count_distinct("part").alias("parts"))
    both = want.join(back, "work_seq", "full_outer").join(spread, "work_seq", "left")
    got = F.transform("back", lambda x: x["line"])
    part = lambda a, *fields: F.sort_array(F.transform(a, lambda x: F.struct(*(x[f] for f in ("last", "first", *fields)))))
    blank = lambda h: reduce(lambda a, b: a & b, (F.coalesce(h[a] == "", F.lit(True)) for a in head))
    count = lambda a, f: F.coalesce(F.size(F.filter(a, f)), F.lit(0))
    full = lambda x: F.concat_ws(" ", x["line"]["first"], x["line"]["last"])
    still = lambda x: F.when(x["line"]["first"] == x["line"]["last"], x["line"]["first"]).otherwise(full(x)).rlike(_STUCK)
    yes = lambda c: F.coalesce(c, F.lit(False))
    alike = lambda *fields: yes(part("due", *fields) == part(got, *fields))
    return both.select(
        "work_seq", F.coalesce("label", F.lit("not in the works")).alias("label"), yes(F.col("in_works")).alias("in_works"), F.coalesce("cells", F.lit(0)).alias("cells"),
        "clashes", F.coalesce("stuck", F.lit(0)).alias("stuck"), yes(F.size("due") > 0).alias("has_due"), count("due", lambda x: x["role"] == "CA").alias("both_roles"),
        F.coalesce(F.when(F.col("back").isNotNull(), F.size("back")), F.lit(0)).alias("n"), count("back", lambda x: x["line"]["role"] == "CA").alias("merged"),
        count("back", lambda x: F.trim(full(x)) != "").alias("named"), count("back", still).alias("still_stuck"), count("back", lambda x: x["unfilled"]).alias("unfilled"),
        yes((F.get("back", F.lit(0))["head"].eqNullSafe(F.col("head"))) & ~F.exists(F.slice("back", 2, F.greatest(F.size("back"), F.lit(1))), lambda x: ~blank(x["head"]))).alias("head_once"),
        yes(F.transform("due", lambda x: F.struct(x["last"], x["first"])) == F.transform(got, lambda x: F.struct(x["last"], x["first"]))).alias("order_same"),
        alike().alias("names_same"), alike("role").alias("roles_same"), alike("ipi").alias("ipis_same"),
        yes(F.col("head")["rec_artist"] != "").alias("sung"), yes(F.get("back", F.lit(0))["head"]["rec_artist"] == F.col("head")["rec_artist"]).alias("artist_same"),
        F.coalesce("parts", F.lit(0)).alias("parts"),
    )


def expansion_checks(works: DataFrame, parts: DataFrame) -> DataFrame:
    """The checks (judged()) of an expansion. works: compared(). parts: file, part and n of each part."""
    faulty = lambda bad: F.when(bad, F.array("label"))
    due, one = F.col("has_due"), F.count(F.lit(1))
    each = lambda c: (F.count_if(due), F.count_if(due & F.col(c)), faulty(due & ~F.col(c)))
    about = judged(works, {
        "a row for each writer": (F.sum("cells"), F.sum(F.col("n") + F.col("merged")), faulty(F.col("cells") != F.col("n") + F.col("merged"))),
        "both roles in one row": (F.sum("both_roles"), F.sum("merged"), faulty(F.col("both_roles") != F.col("merged"))),
        "one identifier for a merged writer": (F.lit(0), F.sum(F.when(F.col("clashes").isNull(), 0).otherwise(F.size("clashes"))), F.col("clashes")),
        "no blank writers": (F.sum("n"), F.sum("named"), faulty(F.col("n") != F.col("named"))),
        "work written once": each("head_once"),
        "writers in order": each("order_same"),
        "roles as in the columns": each("roles_same"),
        "identifiers copied": each("ipis_same"),
        "names split": each("names_same"),
        "identifiers stripped from names": (F.sum("stuck"), F.sum(F.col("stuck") - F.col("still_stuck")), faulty(F.col("still_stuck") > 0)),
        "singers as the recording artist": (F.count_if(due & F.col("sung")), F.count_if(due & F.col("sung") & F.col("artist_same")), faulty(due & F.col("sung") & ~F.col("artist_same"))),
        "fields without a source left blank": (F.sum("n"), F.sum("unfilled"), faulty(F.col("n") != F.col("unfilled"))),
        "work in one part": (F.count_if(F.col("n") > 0), F.count_if((F.col("n") > 0) & (F.col("parts") == 1)), faulty((F.col("n") > 0) & (F.col("parts") != 1))),
        "works with a writer": (F.count_if("in_works"), F.count_if(F.col("in_works") & (F.col("n") > 0)), faulty(F.col("in_works") & (F.col("n") == 0))),
    }, "work_seq")
    named = parts.withColumn("label", F.concat_ws("-", "file", "part"))
    over = F.col("n") > LIMIT
    return about.unionByName(judged(named, {"parts within the limit": (one, F.count_if(~over), faulty(over))}, "part"))
