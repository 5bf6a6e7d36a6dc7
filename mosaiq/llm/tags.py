"""Tag sets: what remains of untidy arrays of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters with Unicode's property White_Space.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def tag_set(tags: Column | str) -> Column:
    """Elements split at commas, trimmed of white space, lower-cased, without nulls, empty strings and repeats, sorted.

    A null array gives an empty one. All elements are joined to one string first, which drops nulls and is cased at once.
    """
    parts = F.split(F.lower(F.concat_ws(",", tags)), ",")
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(parts, lambda t: F.trim(t, F.lit(SPACES)))), ""))


def tag_sets(rows: DataFrame, id_col: str = "id", tags_col: str = "tags", least: int = 1) -> DataFrame:
    """(id, items) for each distinct non-null id whose set has at least `least` items.

    Rows that repeat an id count once; should their sets differ, the id has the union of them.
    """
    sets = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tag_set(tags_col).alias("items")).filter(F.size("items") > 0)
    several = sets.groupBy("id").agg(F.collect_set("items").alias("all"))
    items = F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.sort_array(F.array_distinct(F.flatten("all"))))
    return several.select("id", items.alias("items")).filter(F.size("items") >= least)
