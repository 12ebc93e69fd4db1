"""Royalty reports: one row for each interested party to one wide row for each work, with allocated shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, title_case

#: Percent of each pool, labels of pools and role groups, order of role groups.
POOLS = {"C": 25.0, "A": 25.0, "E": 50.0}
POOL_LABELS = {"C": "Composer", "A": "Author", "E": "Publisher"}
GROUP_LABELS = {
    "C": "Composer", "A": "Author", "AR": "Arranger", "AD": "Adaptor", "TR": "Translator", "E": "Publisher",
    "SE": "Sub Publisher", "SA": "Sub Author", "PA": "Publisher Administrator", "UNSPECIFIED": "Unspecified Role",
}
GROUP_ORDER = ["C", "A", "AR", "AD", "TR", "E", "SE", "SA", "PA"]


def party_name(value: Column) -> Column:
    """LAST, FIRST as First Last; without a comma as it is."""
    s = F.trim(value)
    last, first = F.trim(F.substring_index(s, ",", 1)), F.trim(F.regexp_replace(s, "^[^,]*,", ""))
    return F.when(~F.contains(s, F.lit(",")), s).otherwise(title_case(F.trim(F.concat_ws(" ", first, last))))


def society(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(value), "^[^:]*:", ""))


def report_date(value: Column) -> Column:
    """A date of any accepted format as DD-MM-YYYY; anything else as it is."""
    s = F.trim(value)
    day = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    group = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    iso, slashed = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})(?:[T ]\\d{1,2}:\\d{1,2}:\\d{1,2})?$", "^(\\d{4})/(\\d{1,2})/(\\d{1,2})$"
    dmy = "^(\\d{1,2})([-/])(\\d{1,2})\\2(\\d{4})$"
    found = F.coalesce(
        day(group(iso, 1), group(iso, 2), group(iso, 3)),
        day(group(dmy, 4), group(dmy, 3), group(dmy, 1)),
        F.when(group(dmy, 2) == "/", day(group(dmy, 4), group(dmy, 1), group(dmy, 3))),
        day(group(slashed, 1), group(slashed, 2), group(slashed, 3)),
    )
    return F.coalesce(F.date_format(found, "dd-MM-yyyy"), s)


def distribution_ref(value: Column) -> Column:
    """YYYYMM and a sequence mark as DD-MM-YYYY; a mark that is no digit above 0 is day 1."""
    s = F.regexp_replace(F.trim(value), "\\.0$", "")
    mark = F.regexp_extract(s, "^\\d{6}(.)$", 1)
    day = F.when(mark.rlike("^[1-9]$"), F.lpad(mark, 2, "0")).otherwise("01")
    return F.when(s.rlike("^\\d{6}.?$"), F.concat_ws("-", day, F.substring(s, 5, 2), F.substring(s, 1, 4))).otherwise(report_date(s))


def report_duration(value: Column) -> Column:
    s = F.trim(value)
    part = lambda p, i: F.lpad(F.regexp_extract(s, p, i), 2, "0")
    long_, short = "^(\\d{1,3}):(\\d{1,2}):(\\d{1,2})(?:\\.\\d+)?$", "^(\\d{1,2}):(\\d{1,2})$"
    hours = F.regexp_extract(s, long_, 1)
    total = F.when(s.rlike("^\\d{1,15}$"), s).cast("long")
    plain = F.concat_ws(":", F.lpad(F.floor(total / 3600).cast("string"), 2, "0"), F.lpad(F.floor(total % 3600 / 60).cast("string"), 2, "0"), F.lpad((total % 60).cast("string"), 2, "0"))
    return (
        F.when(s.rlike(long_), F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(F.format_string("%02d", hours.cast("int"))), part(long_, 2), part(long_, 3)))
        .when(s.rlike(short), F.concat_ws(":", F.lit("00"), part(short, 1), part(short, 2)))
        .when(total.isNotNull(), plain)
        .otherwise(s)
    )


def role_group(role: Column) -> Column:
    code = F.upper(F.trim(role))
    return F.when(code == "", "UNSPECIFIED").when(F.contains(code, F.lit("C")), "C").otherwise(code)


def share_pools(role: Column) -> Column:
    """The pools a role draws from: writers of both kinds from both."""
    code, group = F.upper(F.trim(role)), role_group(role)
    return (
        F.when((group == "C") & F.contains(code, F.lit("A")), F.array(F.lit("C"), F.lit("A")))
        .when(group.isin("C", "A", "E"), F.array(group))
        .otherwise(F.array().cast("array<string>"))
    )


def format_share(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(value.cast("decimal(20,4)").cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    return F.when(text == "", "0").otherwise(text)


#: Rows of a partition of works, so that a task's memory doesn't grow with the report.
ROWS_A_PART = 250_000


def parts_of(rows: DataFrame, n: int) -> int:
    """To how many tasks n rows are dealt."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_PART))


def by_work(rows: DataFrame, n: int, key: str = "work_key") -> DataFrame:
    """n rows dealt by work (key): every step that groups by work, or by more than the work, then needs no exchange of its own."""
    return rows.repartition(parts_of(rows, n), key)


def parties(raw: DataFrame, columns: list[str], n: int = 0) -> DataFrame:
    """raw (seq, work_key, role and other columns, transformed; about n rows) without blank keys and without exact repeats."""
    return once(by_work(raw.withColumn("work_key", F.trim("work_key")).filter("work_key <> ''"), n), columns)


def once(kept: DataFrame, columns: list[str]) -> DataFrame:
    """kept (seq and columns, dealt by work) without exact repeats; the first seq stands for them."""
    first = kept.groupBy(*columns).agg(F.min("seq").alias("seq"))
    return first.select("seq", *columns)


def allocate(rows: DataFrame) -> DataFrame:
    """rows (seq, work_key, role) with share: each pool split evenly, what rounding leaves to the pool's last holder.

    Windows are over one work, of which there are as many rows as it has parties."""
    every = Window.partitionBy("work_key").orderBy("seq")
    holds = {p: F.coalesce(F.array_contains(share_pools(F.col("role")), p), F.lit(False)) for p in POOLS}
    whole, before = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), every.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumns({f"_holds_{p}": c for p, c in holds.items()})
    held = held.withColumns({f"_n_{p}": F.count_if(f"_holds_{p}").over(whole) for p in POOLS} | {f"_place_{p}": F.count_if(f"_holds_{p}").over(before) for p in POOLS})

    def part(p: str, total: float) -> Column:
        n, each = F.col(f"_n_{p}"), F.bround(F.lit(total) / F.greatest(F.col(f"_n_{p}"), F.lit(1)), 4)
        last = F.bround(F.lit(total) - each * (n - 1), 4)
        return F.when(F.col(f"_holds_{p}"), F.when(F.col(f"_place_{p}") == n, last).otherwise(each)).otherwise(0.0).cast("decimal(20,4)")

    share = reduce(lambda a, b: a + b, (part(p, total) for p, total in POOLS.items()))
    return held.select(*rows.columns, format_share(share).alias("share"))


def issues(rows: DataFrame) -> DataFrame:
    """work_key and the pools nobody holds, as a message (blank if none)."""
    held = rows.groupBy("work_key").agg(F.flatten(F.collect_set(share_pools(F.col("role")))).alias("held"))
    return held.select("work_key", _unheld(F.col("held")).alias("issue"))


def _unheld(held: Column) -> Column:
    """The message on the pools that held, a work's list, lacks."""
    missing = F.array_compact(F.array(*(F.when(~F.array_contains(held, p), POOL_LABELS[p]) for p in POOLS)))

    def message(m: Column) -> Column:
        n = F.size(m)
        names = F.when(n > 1, F.concat_ws(" and ", F.array_join(F.slice(m, 1, n - 1), ", "), F.element_at(m, -1))).otherwise(F.array_join(m, ""))
        return F.when(n == 0, "").otherwise(F.concat(names, F.lit(" share not allocated")))

    return let(missing, message)


def budget(rows: DataFrame) -> DataFrame:
    """grp and the most parties of it that any work has."""
    counts = rows.groupBy("work_key", role_group(F.col("role")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("grp").agg(F.max("n").alias("slots"))


def demoted(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns of works that vary inside some work."""
    varies = rows.groupBy("work_key").agg(*((F.min(c) != F.max(c)).alias(c) for c in columns))
    flags = varies.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in columns)).first()
    return [c for c in columns if flags[c]]


def group_order(groups: list[str]) -> list[str]:
    return [g for g in GROUP_ORDER if g in groups] + sorted(g for g in groups if g not in GROUP_ORDER)


def slotted(rows: DataFrame) -> DataFrame:
    """rows with grp and slot, the party's place among those of its group in its work."""
    own = rows.withColumn("grp", role_group(F.col("role")))
    return own.withColumn("slot", F.row_number().over(Window.partitionBy("work_key", "grp").orderBy("seq")))


def wide(rows: DataFrame, work_columns: list[str], fields: dict[str, str]) -> DataFrame:
    """One row a work: work_columns, a column for each slot and field (of fields: source -> label), issue.

    The budget of slots is a few dozen rows, and fixes the pivot's columns before it runs."""
    slots = {r["grp"]: r["slots"] for r in budget(rows).collect()}
    places = [(g, i) for g in group_order(list(slots)) for i in range(1, slots[g] + 1)]
    placed = slotted(rows)
    pick = lambda g, i, f: F.max(F.when((F.col("grp") == g) & (F.col("slot") == i), F.col(f)))
    cells = [F.coalesce(pick(g, i, f), F.lit("")).alias(f"{GROUP_LABELS.get(g, g)} {i} {label}") for g, i in places for f, label in fields.items()]
    works = placed.groupBy("work_key").agg(*(F.min_by(c, "seq").alias(c) for c in work_columns), *cells)
    return works.join(issues(rows), "work_key")


def blocks(rows: DataFrame, work_columns: list[str], fields: list[str]) -> DataFrame:
    """One row a work: work_columns, issue, and parties: for each role group that it has, its parties' fields in order.
    How many parties some other work has doesn't matter; wide() makes columns of them for a sheet."""
    own = slotted(rows).groupBy("work_key", "grp").agg(
        F.min_by(F.struct(*work_columns), "seq").alias("work"), F.min("seq").alias("seq"),
        F.transform(F.sort_array(F.collect_list(F.struct("slot", F.struct(*fields).alias("party")))), lambda x: x["party"]).alias("parties"),
        F.flatten(F.collect_set(share_pools(F.col("role")))).alias("held"),
    )
    works = own.groupBy("work_key").agg(F.min_by("work", "seq").alias("work"), F.map_from_entries(F.collect_list(F.struct("grp", "parties"))).alias("parties"), F.flatten(F.collect_list("held")).alias("held"))
    return works.select("work_key", "work.*", "parties", _unheld(F.col("held")).alias("issue"))


def long_again(wide_rows: DataFrame, fields: dict[str, str], groups: dict[str, int]) -> DataFrame:
    """work_key, grp, slot and fields back from wide rows, to check that nothing moved."""
    places = [(g, i) for g in groups for i in range(1, groups[g] + 1)]
    cells = [F.struct(F.lit(g).alias("grp"), F.lit(i).alias("slot"), *(F.col(f"`{GROUP_LABELS.get(g, g)} {i} {label}`").alias(f) for f, label in fields.items())) for g, i in places]
    return wide_rows.select("work_key", F.explode(F.array(*cells)).alias("c")).select("work_key", "c.*")


def compared(rows: DataFrame, table: DataFrame, work_columns: list[str], fields: list[str]) -> DataFrame:
    """A row for each work, to check table (blocks() of rows) against rows, the parties with their shares: in_rows, written (rows
    of table), parties, back (parties in table), set_same and order_same (the parties of each group, as a set and in order),
    placed (parties in table that are the work's own), head_same (work columns hold the work's one value), combined and
    routed (composers of further roles, and those in the composers' block), shared (parties whose share is as allocated),
    total (of shares), full (no pool is missing). Each list is of one work, so none is larger than a work."""
    party = lambda x: F.struct(*(x[f] for f in fields))
    own = slotted(rows).groupBy("work_key").agg(
        F.count(F.lit(1)).alias("parties"), F.sort_array(F.collect_list(F.struct("grp", F.col("slot").cast("int").alias("slot"), F.struct(*fields).alias("party")))).alias("own"),
        *(F.min(c).alias(f"low_{c}") for c in work_columns), *(F.max(c).alias(f"high_{c}") for c in work_columns), F.sum(F.col("share").cast("decimal(20,4)")).alias("total"),
    )
    listed = F.flatten(F.transform(F.map_entries("parties"), lambda e: F.transform(e["value"], lambda p, i: F.struct(e["key"].alias("grp"), (i + 1).alias("slot"), party(p).alias("party")))))
    back = table.withColumn("back", listed).groupBy("work_key").agg(F.count(F.lit(1)).alias("written"), F.sort_array(F.flatten(F.collect_list("back"))).alias("back"), F.first("issue").alias("issue"), *(F.first(c).alias(c) for c in work_columns))
    both = own.withColumn("in_rows", F.lit(True)).join(back, "work_key", "full_outer")
    unplaced = lambda a: F.sort_array(F.transform(a, lambda x: F.struct(x["grp"], x["party"])))
    composer = lambda a: F.size(F.filter(a, lambda x: (role_group(x["party"]["role"]) == "C") & (F.upper(F.trim(x["party"]["role"])) != "C")))
    routed = F.size(F.filter("back", lambda x: (x["grp"] == "C") & (role_group(x["party"]["role"]) == "C") & (F.upper(F.trim(x["party"]["role"])) != "C")))
    heads = [(F.col(f"low_{c}") == F.col(f"high_{c}")) & (F.col(c) == F.col(f"low_{c}")) for c in work_columns]
    same = F.lit(True)
    for h in heads:
        same = same & h
    return both.select(
        "work_key", F.coalesce("in_rows", F.lit(False)).alias("in_rows"), F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("parties", F.lit(0)).alias("parties"),
        F.when(F.col("back").isNull(), 0).otherwise(F.size("back")).alias("back"),
        F.coalesce(unplaced("own") == unplaced("back"), F.lit(False)).alias("set_same"), F.coalesce(F.col("own") == F.col("back"), F.lit(False)).alias("order_same"),
        F.coalesce(F.size(F.filter("back", lambda x: F.exists("own", lambda y: y["party"] == x["party"]))), F.lit(0)).alias("placed"), F.coalesce(same, F.lit(False)).alias("head_same"),
        F.coalesce(composer("own"), F.lit(0)).alias("combined"), F.coalesce(routed, F.lit(0)).alias("routed"),
        F.coalesce(F.size(F.filter("back", lambda x: (x["party"]["share"] != "") & F.exists("own", lambda y: y["party"] == x["party"]))), F.lit(0)).alias("shared"),
        F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("issue", F.lit("?")) == "").alias("full"),
    )


def evenly_held(rows: DataFrame) -> DataFrame:
    """seq and near of each party that draws from a pool: whether its share is an even part of its pools, worked out anew from
    the numbers of their holders, but for what rounding to four places leaves to a pool's last holder. Every step groups by work
    and more, so that rows dealt by work stay where they are."""
    total = F.create_map(*(F.lit(x) for p in POOLS.items() for x in p))
    held = rows.select("seq", "work_key", F.col("share").cast("double").alias("share"), F.explode(share_pools(F.col("role"))).alias("pool"))
    counted = held.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("work_key", "pool")))
    own = counted.groupBy("work_key", "seq").agg(F.first("share").alias("share"), F.sum(total[F.col("pool")] / F.col("n")).alias("due"), F.sum("n").alias("slack"))
    return own.select("seq", (F.abs(F.col("share") - F.col("due")) <= 0.0001 * F.col("slack")).alias("near"))


def source_checks(raw: DataFrame, kept: DataFrame, key: str | None = None) -> DataFrame:
    """raw rows (name and society as in the report, and as changed: new_name, new_society, with n rows alike) as counts to
    check: commas, turned, prefixed, stripped, repeats; and kept, how many rows are left of them. key: a column of raw that whole
    holds too, so that different rows can be counted key by key, where they were dealt by it."""
    comma, prefix = F.contains(F.trim("name"), F.lit(",")), F.trim("society").rlike("^\\d+\\s*:")
    counts = raw.groupBy(*([key] if key else [])).agg(
        F.count_if(comma).alias("commas"), F.count_if(comma & ~F.contains("new_name", F.lit(","))).alias("turned"),
        F.count_if(prefix).alias("prefixed"), F.count_if(prefix & ~F.col("new_society").rlike("^\\d+\\s*:")).alias("stripped"), F.count(F.lit(1)).alias("n"), F.count_distinct("whole").alias("different"),
    )
    if key:
        counts = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns if c != key))
    left = kept.agg(F.count(F.lit(1)).alias("left"))
    return counts.join(left, F.lit(True)).withColumns({"repeats": F.col("n") - F.col("different"), "removed": F.col("n") - F.col("left")})
