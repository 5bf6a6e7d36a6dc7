"""Problem 5: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """How one field of the surviving record is chosen: of the rows where `usable` holds, the one with the largest keys.

    keys are compared one after the other, a null below everything; value is what is kept of the chosen row.
    """

    value: Column
    keys: tuple[Column, ...]
    usable: Column | None = None


def survivors(rows: DataFrame, group: str, fields: Mapping[str, Field]) -> DataFrame:
    """One row for each group with, for every field, the value of the row that wins it.

    A single aggregation: for each field the maximum of a struct of its keys and its value, over usable rows only, so
    any number of fields costs one shuffle and one partial result a group and partition, however large a group is. A
    group without a usable row for a field has null there. Repeated rows change nothing. A null group is dropped. If keys
    leave a tie, the larger value wins, so the result never depends on the order of rows.
    """
    best = []
    for name, f in fields.items():
        key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(f.keys)], f.value.alias("value"))
        best.append(F.max(key if f.usable is None else F.when(f.usable, key)).alias(name))
    grouped = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(*best)
    return grouped.select(group, *[F.col(name)["value"].alias(name) for name in fields])


def source_rank(source: Column, trusted: tuple[str, ...]) -> Column:
    """The larger the more trusted: the first of `trusted` is highest, any other value and null are 0; case and surrounding space don't matter."""
    clean, rank = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit(0)
    for i, name in enumerate(reversed(trusted)):
        rank = F.when(clean == name, i + 1).otherwise(rank)
    return F.coalesce(rank, F.lit(0))


def text_length(text: Column) -> Column:
    """Characters (code points) without surrounding white space."""
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
