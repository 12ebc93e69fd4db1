"""Columns of the master table beyond the canonical ones. Which there are is metadata, a few hundred names at most."""

from __future__ import annotations

import re
from itertools import chain, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import ATTRIBUTES

LONGEST = 63


def attribute(name: str, taken: set[str]) -> str:
    """A column name of small letters, digits and _ that starts with x_ and isn't taken."""
    base = f"x_{'_'.join(re.findall('[a-z0-9]+', name.lower()))}"[:LONGEST].rstrip("_")
    ends = (f"_{n}" for n in count(1))
    return next(c for c in chain([base], (base[: LONGEST - len(e)] + e for e in ends)) if c not in taken)


def promoted(registry: dict[str, str], names: list[str]) -> dict[str, str]:
    """registry (name -> attribute) with names that are neither canonical nor in it, case aside. Raises ValueError for a
    blank name."""
    out = dict(registry)
    for name in map(str.strip, names):
        if not name:
            raise ValueError("A column name is required.")
        if name not in ATTRIBUTES and name.lower() not in {n.lower() for n in out}:
            out[name] = attribute(name, {*ATTRIBUTES.values(), *out.values()})
    return out


def widened(master: DataFrame, registry: dict[str, str]) -> DataFrame:
    """master with a blank text column for each attribute it lacks; files written before it need no rewriting."""
    return master.withColumns({a: F.lit("") for a in registry.values() if a not in master.columns})


def filled(master: DataFrame, new: DataFrame, registry: dict[str, str]) -> DataFrame:
    """master with blank custom cells filled from the first new record (fingerprint, row_index, attributes) of the same
    fingerprint that has a value; others stay. Null counts as blank."""
    attributes = list(registry.values())
    text = lambda a: F.when(F.trim(a) != "", F.col(a))
    first = new.groupBy("fingerprint").agg(*(F.min_by(F.col(a), F.when(text(a).isNotNull(), F.col("row_index"))).alias(f"_{a}") for a in attributes))
    both = master.join(first, "fingerprint", "left")
    return both.select(*(F.coalesce(text(c), F.col(f"_{c}"), F.lit("")).alias(c) if c in attributes else F.col(c) for c in master.columns))
