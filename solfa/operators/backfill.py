"""Values kept in a bag of JSON (one object in a text cell) laid out as columns.

Two passes: one finds the keys and the type that all values of a key share, the other parses each bag once, as a variant, and
reads every key from it. Cells that are null, no JSON, or no object are empty bags; an object that repeats a key is no valid bag,
and text after an object is ignored."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import custom

#: Keys become columns, so there may be as many as a table can sensibly have; more are refused, not dropped.
MAX_KEYS = 500
#: Merged types that a column can have; all others are text.
TYPES = ("BOOLEAN", "BIGINT", "DOUBLE", "STRING")


class TooManyKeys(ValueError):
    pass


def _bag(column: str) -> Column:
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def _at(bag: Column, key: str, kind: str = "string") -> Column:
    """The value of a key. A path can't hold both kinds of quotes; such keys are refused by keys()."""
    return F.try_variant_get(bag, f"$['{key}']" if '"' in key else f'$["{key}"]', kind)


def keys(rows: DataFrame, column: str, limit: int = MAX_KEYS) -> list[str]:
    """The keys of all bags, sorted. Raises TooManyKeys beyond the limit and ValueError for a key with both kinds of quotes."""
    named = rows.select(F.explode(F.json_object_keys(F.to_json(_bag(column)))).alias("key")).distinct().limit(limit + 1)
    found = sorted(r["key"] for r in named.collect())
    if len(found) > limit:
        raise TooManyKeys(f"more than {limit} keys in {column}")
    if any("'" in k and '"' in k for k in found):
        raise ValueError(f"a key of {column} has both kinds of quotes")
    return found


def layout(rows: DataFrame, column: str, limit: int = MAX_KEYS) -> dict[str, str]:
    """Each key with the type that all its values share: BOOLEAN, BIGINT, DOUBLE (numbers not all whole) or STRING."""
    names = keys(rows, column, limit)
    if not names:
        return {}
    shared = rows.select(_bag(column).alias("bag")).agg(*(F.schema_of_variant_agg(_at(F.col("bag"), k, "variant")).alias(f"t{i}") for i, k in enumerate(names))).first()
    kind = lambda t: "BIGINT" if t in ("DECIMAL(19,0)", "DECIMAL(20,0)") else "DOUBLE" if t.startswith(("DECIMAL", "FLOAT")) else t if t in TYPES else "STRING"
    return {k: kind(shared[i]) for i, k in enumerate(names)}


def field_names(keys: list[str]) -> dict[str, str]:
    """A field for each key: its own name, with a number if an earlier one is the same case aside (Spark tells fields by that)."""
    out, taken = {}, {k.lower() for k in keys}
    for key in keys:
        clash = key.lower() in {f.lower() for f in out.values()}
        out[key] = next(f for f in (f"{key}_{n}" for n in count(2)) if f.lower() not in taken) if clash else key
        taken.add(out[key].lower())
    return out


def columns(rows: DataFrame, column: str, kinds: dict[str, str]) -> DataFrame:
    """rows with bag, a structure of a field (field_names()) for each key of kinds (layout()), in place of the column; no key can clash with
    a column of rows. A value that is missing, null or not of the key's type is null."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]
    named = field_names(list(kinds))
    fields = [_at(F.col("_bag"), k, t.lower()).alias(named[k]) for k, t in kinds.items()]
    parsed = rows.withColumn("_bag", _bag(column))
    return parsed.select(*kept, (F.struct(*fields) if fields else F.lit(None).cast("struct<>")).alias("bag"))


def backfilled(rows: DataFrame, column: str, registry: dict[str, str], limit: int = MAX_KEYS) -> tuple[DataFrame, dict[str, str]]:
    """rows without the bag, with a text column for each custom column, and the registry widened by keys it lacked. A value in
    the bag replaces the cell; where there is none the cell stays, and a new column's cell is blank. Keys that differ from a
    column's name in case alone fill it too, after the exact name; keys of canonical columns, and blank ones, stay out."""
    names = [k for k in keys(rows, column, limit) if k.strip()]
    registry = custom.promoted(registry, names)
    wide = custom.widened(rows, registry).withColumn("_bag", _bag(column))
    spelled = {n: sorted((k for k in names if k.strip().lower() == n.lower()), key=lambda k: (k != n, k)) for n in registry}
    filled = {a: F.coalesce(*(_at(F.col("_bag"), k) for k in spelled[n]), F.col(a), F.lit("")) for n, a in registry.items()}
    return wide.withColumns(filled).drop("_bag", column), registry
