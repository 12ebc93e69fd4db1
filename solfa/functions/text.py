"""Text primitives as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .schema import PLACEHOLDERS, SEPARATOR


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it: expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Stages:
    """Values that stage() names, as columns of projections one after another: a value is a column of a later projection than
    all that it can name. Spark compiles these; the body of a lambda it interprets."""

    def __init__(self) -> None:
        self.levels: list[list[Column]] = []
        self.at = 0

    def named(self, value: Column) -> Column:
        if self.at == len(self.levels):
            self.levels.append([])
        name = f"_stage_{self.at}_{len(self.levels[self.at])}"
        self.levels[self.at].append(value.alias(name))
        self.at += 1
        return F.col(name)


_OPEN: list[Stages] = []


@contextmanager
def staging() -> Iterator[Stages]:
    """Within it stage() makes columns of projections; without it, lambdas."""
    _OPEN.append(Stages())
    try:
        yield _OPEN[-1]
    finally:
        _OPEN.pop()


def stage(value: Column, body: Callable[[Column], Column]) -> Column:
    """let() for what is not inside a lambda. In a staging() value is worked out on every row, also behind a condition."""
    return body(_OPEN[-1].named(value)) if _OPEN else let(value, body)


def side_by_side(makers: list[Callable[[], Column]]) -> list[Column]:
    """Columns that don't name each other's values, so that they share projections."""
    if not _OPEN:
        return [make() for make in makers]
    stages, out = _OPEN[-1], []
    begin = last = stages.at
    for make in makers:
        stages.at = begin
        out.append(make())
        last = max(last, stages.at)
    stages.at = last
    return out


def base_text(raw: Column, ascii_only: bool = False) -> Column:
    """Escapes of control characters and control characters out, NFKC, white space collapsed. Null is ''.

    Spark has no NFKC, so values with other than ASCII go through Arrow; ascii_only leaves that out of the plan."""
    kept = F.regexp_replace(F.coalesce(raw, F.lit("")), "_x[0-9A-Fa-f]{4}_", " ")
    kept = F.regexp_replace(kept, "[\\x00-\\x08\\x0a-\\x1f]", "")
    if not ascii_only:
        kept = F.when(kept.rlike("[^\\x00-\\x7F]"), _nfkc(F.when(kept.rlike("[^\\x00-\\x7F]"), kept))).otherwise(kept)
    return F.trim(F.regexp_replace(kept, "(?U)\\s+", " "))


def is_placeholder(base: Column) -> Column:
    return F.lower(base).isin(*PLACEHOLDERS) | ~base.rlike("[\\p{L}\\p{N}]")


def is_garbled(raw: Column) -> Column:
    dollars = F.length(raw) - F.length(F.replace(raw, F.lit("$"), F.lit("")))
    return raw.rlike("_x[0-9A-Fa-f]{4}_") | (dollars >= 2) | (F.contains(raw, F.lit("`")) & (dollars > 0))


def title_case(value: Column) -> Column:
    """A capital after any character without case, small letters after others (initcap knows white space only)."""

    def cased(letters: Column) -> Column:
        before = lambda i: F.element_at(letters, F.greatest(i, F.lit(1)))
        return F.transform(letters, lambda c, i: F.when((i > 0) & before(i).rlike("[\\p{Lu}\\p{Ll}\\p{Lt}]"), F.lower(c)).otherwise(F.upper(c)))

    # ASCII: a marked space behind each character without case, which initcap starts a word after
    marked = F.initcap(F.regexp_replace(value, "[^A-Za-z]", "$0\u0001 "))
    plain = F.replace(marked, F.lit("\u0001 "), F.lit(""))
    return F.when(value.rlike("[^\\x02-\\x7F]"), F.array_join(let(F.split(value, ""), cased), "")).otherwise(plain)


def name_problem(part: Column) -> Column:
    """Message on a name or title that doesn't look right, or null."""
    return (
        F.when(part.rlike(r'[$%@#^*=+~<>{}\[\]\\"`]'), "Contains unexpected symbols — please check.")
        .when(~part.rlike("\\s") & F.regexp_replace(part, "[^\\p{L}]", "").rlike("^\\p{Lu}{2,}$"), "All-caps single word — confirm the real name.")
        .when(part.rlike("[a-z][A-Z]|[A-Z]{2,}[a-z]"), "Unusual capitalization — confirm the real name.")
    )


def merge_key(value: Column) -> Column:
    """Identity for merging: white space collapsed, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "(?U)\\s+", " "))


def norm(value: Column) -> Column:
    """Identity for comparing records: merge_key without case."""
    return F.lower(merge_key(value))


def pieces(value: Column, is_name: bool = True) -> Column:
    """Names of a joined cell, or the whole value; none of a blank cell."""
    if not is_name:
        return F.when(F.trim(value) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(value)))
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "\\s*\\|\\s*"), lambda x: F.trim(x)), lambda x: x != "")


def joined(values: Column) -> Column:
    return F.array_join(values, SEPARATOR)


def distinct_by_lower(values: Column) -> Column:
    """First spelling of each value, case aside, in order."""
    return let(values, lambda v: let(F.transform(v, F.lower), lambda low: F.filter(v, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def token_sorted(value: Column) -> Column:
    return F.array_join(F.array_sort(F.split(value, "\\s+")), " ")
