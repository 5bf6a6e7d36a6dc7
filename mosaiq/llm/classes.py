"""From pairs of classes of equal records to pairs of their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch


def member_pairs(s: Scratch, pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, for every two members of each pair of classes; a pair (c, c) gives the pairs within c.

    pairs: (ca, cb), each unordered pair once. members: (id, c), each id once; both tables. The work is that of the
    result: a class meets another only if they are a pair, and classes with many members are cut into blocks.
    """
    left = members.select(F.col("c").alias("ca"), F.col("id").alias("x"))
    right = members.select(F.col("c").alias("cb"), F.col("id").alias("y"))
    half = s.save(skew_join(pairs, left, ["ca"]), "pairs-half")
    both = skew_join(half, right, ["cb"]).filter("ca <> cb or x < y")
    return both.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
