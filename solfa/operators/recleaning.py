"""Rows of a cleaned dataset with a reviewer's corrections, cleaned again; and the whole review of a dataset.

Only corrected rows are cleaned again. Their cells become long rows, a cell each with the name of its column, and one
expression cleans them all by the type of the row's column, so the plan has one cleaner a type, whatever the columns. Back as
rows, the lead artist follows the credits: names that no credit has any more go, or are respelled where they stand if a
credit of as many names was. Rows without a correction pass as they are.

Defined results: a correction of a column that the row lacks adds it; corrections of rows that don't exist are left out;
nulls count as blank; of several corrections of a cell overlay.current() has settled the one that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_cell
from ..functions.schema import CREDITS, REQUIRED
from ..functions.text import joined, let, pieces
from ..sources.storage import stored
from .cleaning import ISSUE, LEAD, issue, lead_artist
from .duplicates import mark_duplicates

_NONE = "array<string>"


def _lowered(names: Column) -> Column:
    return F.transform(names, F.lower)


def renames(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """(was in lower case, now) of the names that stand at one place of a column before and after, in order of columns;
    columns whose number of names differs say nothing."""
    pairs = []
    for c in before:
        old, new = pieces(before[c]), pieces(after[c])
        both = F.zip_with(old, new, lambda a, b: F.struct(F.lower(a).alias("was"), b.alias("now")))
        other = F.filter(both, lambda x: x["was"] != F.lower(x["now"]))
        pairs.append(F.when(F.size(old) == F.size(new), other).otherwise(F.filter(both, lambda x: F.lit(False))))
    return F.flatten(F.array(*pairs))


def reflowed(lead: Column, before: dict[str, Column], after: dict[str, Column]) -> Column:
    """lead without the names that credits had before and no credit has after; one that was respelled stays in its place with the
    new spelling (of several the last column's). Names that no credit ever had stay."""
    names = lambda credits: F.flatten(F.array(*(pieces(c) for c in credits.values())))

    def kept(s: Column) -> Column:
        def one(p: Column) -> Column:
            new = F.filter(s["renames"], lambda r: r["was"] == F.lower(p))
            return F.when(~F.array_contains(s["stale"], F.lower(p)), F.array(p)).when(F.size(new) > 0, F.array(F.element_at(new, -1)["now"])).otherwise(F.array().cast(_NONE))

        return F.when(F.size(s["stale"]) == 0, s["lead"]).otherwise(joined(F.flatten(F.transform(pieces(s["lead"]), one))))

    stale = F.array_except(_lowered(names(before)), _lowered(names(after)))
    return let(F.struct(lead.alias("lead"), stale.alias("stale"), renames(before, after).alias("renames")), kept)


def recleaned(cleaned: DataFrame, corrections: DataFrame, as_of: int = 2026, ascii_only: bool = False) -> DataFrame:
    """cleaned (row_index, values, issues) with corrections (row_index, col, value, is_merge) applied: corrected rows get the
    issues of their cells as they are now, and a mark (corrected, or merged) on each changed cell without an error."""
    over = corrections.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("is_merge", F.lit(False)).alias("is_merge"))))).alias("over"))
    rows = cleaned.select("row_index", "values").join(over, "row_index")
    long = rows.select("row_index", "values", "over", F.posexplode(F.array_union(F.map_keys("values"), F.map_keys("over"))).alias("at", "col"))
    was, new = F.try_element_at("values", F.col("col")), F.try_element_at("over", F.col("col"))
    raw = F.coalesce(new["value"], was, F.lit(""))
    cells = long.select("row_index", "at", "col", was.alias("was"), new.alias("new"), clean_cell(F.col("col"), raw, as_of, ascii_only).alias("cell"))
    by_row = cells.groupBy("row_index").agg(F.array_sort(F.collect_list(F.struct("at", "col", "was", "new", "cell"))).alias("c"))

    def noted(e: Column) -> Column:
        cell = e["cell"]
        own = issue(e["col"], cell["action"], cell["tag"], cell["message"], cell["value"], cell["original"], cell["cosmetic"])
        missing = issue(e["col"], "error", "missing_required", F.concat(e["col"], F.lit(" is required but empty.")), F.lit(""), cell["original"])
        return F.array_compact(F.array(F.when(cell["action"] != "ok", own), F.when(e["col"].isin(*REQUIRED) & (cell["value"] == ""), missing)))

    entries = lambda pick, keep=None: F.map_from_entries(F.transform(F.col("c") if keep is None else F.filter("c", keep), lambda e: F.struct(e["col"].alias("key"), pick(e).alias("value"))))
    done = by_row.select(
        "row_index", entries(lambda e: e["cell"]["value"]).alias("values"), entries(lambda e: e["was"], lambda e: e["was"].isNotNull()).alias("base"),
        entries(lambda e: e["new"]["is_merge"], lambda e: e["new"].isNotNull()).alias("over"), F.flatten(F.transform("c", noted)).cast(f"array<{ISSUE}>").alias("issues"),
    )
    of = lambda m: {c: F.try_element_at(m, F.lit(c)) for c in CREDITS}
    value = F.try_element_at("values", F.lit(LEAD))
    by_hand = F.map_contains_key("over", LEAD)
    led = done.withColumn("had", F.when(by_hand, value).otherwise(reflowed(value, of("base"), of("values"))))
    led = led.withColumn("lead", lead_artist(F.col("had"), [F.col("values")[c] for c in CREDITS]))
    blocked = F.exists("issues", lambda x: (x["column"] == LEAD) & (x["action"] == "error"))
    fill = ~by_hand & ~blocked & (F.col("lead") != F.coalesce("had", F.lit("")))
    others = F.filter("issues", lambda x: ~((x["column"] == LEAD) & (x["action"] == "fixed")))
    note = issue(LEAD, "fixed", "derived_lead_artist", "Filled from Singer / Composer / Lyricist (duplicates removed).", F.col("lead"), F.coalesce("had", F.lit("")))
    final = F.when(fill, F.col("lead")).otherwise(F.col("had"))
    without = F.map_filter("values", lambda k, v: k != LEAD)
    full = led.select(
        "row_index", "base", "over", F.when(final.isNull(), without).otherwise(F.map_concat(without, F.create_map(F.lit(LEAD), final))).alias("values"),
        F.when(fill, F.array_append(others, note)).otherwise(F.col("issues")).alias("issues"),
    )
    touched = full.select("row_index", "values", _marked().alias("issues"))
    return cleaned.select("row_index", "values", "issues").join(over.select("row_index"), "row_index", "left_anti").unionByName(touched)


def _marked() -> Column:
    """issues with a mark on each corrected cell whose value is not what it was and that has no error, in place of its notes."""
    text = lambda m, c: F.coalesce(F.try_element_at(F.col(m), c), F.lit(""))
    edited = F.filter(F.map_keys("over"), lambda c: text("values", c) != text("base", c))
    wrong = F.transform(F.filter("issues", lambda x: x["action"] == "error"), lambda x: x["column"])

    def marked(s: Column) -> Column:
        kept = F.filter(s["issues"], lambda x: ~F.array_contains(s["edited"], x["column"]) | (x["action"] == "error"))
        merged = lambda c: F.try_element_at(F.col("over"), c)
        mark = lambda c: issue(
            c, "fixed", F.when(merged(c), "merged").otherwise("corrected"), F.when(merged(c), "Merged value in review.").otherwise("Manually corrected in review."), text("values", c), text("base", c)
        )
        return F.concat(kept, F.transform(F.array_except(s["edited"], s["wrong"]), mark))

    return let(F.struct(F.col("issues").alias("issues"), edited.alias("edited"), wrong.alias("wrong")), marked)


def reviewed(cleaned: DataFrame, corrections: DataFrame, dropped: DataFrame, accepted: DataFrame, fields: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that were dropped, after corrections: duplicates are told among those that stay, and the errors
    of accepted rows are cleared last. fields: columns of the dataset."""
    rows = stored(recleaned(cleaned, corrections, **options), "recleaned")  # read by flags, by rows that stay and by those that go
    gone = dropped.select("row_index").distinct()
    marked = mark_duplicates(rows.join(gone, "row_index", "left_anti"), fields)
    kept = marked.join(accepted.select("row_index").distinct().withColumn("as_is", F.lit(True)), "row_index", "left")
    issues = F.when(F.col("as_is"), F.filter("issues", lambda x: x["action"] != "error")).otherwise(F.col("issues"))
    return kept.select("row_index", "values", issues.alias("issues")), rows.join(gone, "row_index", "left_semi")
