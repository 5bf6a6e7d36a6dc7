"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than an even share of a join's task, but no key of fewer rows than this is.
HOT_ROWS = 100_000


def hot_keys(side: DataFrame, on: list[str], limit: int) -> dict[tuple, int]:
    """Keys with more than `limit` rows, and their number of rows; counted map-side."""
    given = side.filter(" and ".join(f"`{c}` is not null" for c in on))
    counted = given.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return {tuple(r[c] for c in on): r["_rows"] for r in counted.collect()}


def hot_limit(rows: int, partitions: int, least: int) -> int:
    """Rows of a key above which it is cut: an even share of the rows, so that there are fewer hot keys than partitions."""
    return max(least, -(-rows // max(1, partitions)))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, least: int = HOT_ROWS, unique: bool = False, hot_left: dict[tuple, int] | None = None) -> DataFrame:
    """left.join(right, on, how), with hot keys cut into blocks on both sides.

    A key is hot if it has more rows on a side than that side's rows divided by the number of shuffle partitions (and than
    `least`), so that the table of hot keys, which is collected and broadcast, is shorter than twice the number of
    partitions. A side of at most `least` rows isn't looked at. Rows of a hot key get a block number from their own hash
    and their place in the table; each block of one side meets each block of the other exactly once, so the result is that
    of the plain join. how: inner; left, left_semi and left_anti split the left side only. unique: right has one row a key.
    hot_left: the left side's hot keys and their rows, where the caller knows them, so that they aren't counted. The
    sides are scanned more than once, and a place must be the same again after a lost task: pass written tables. Null
    keys never match, as in SQL.
    """
    both = not unique and how == "inner"
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, limits = [{}, {}], [least, least]
    for i, side in enumerate([left, right] if both else [left]):
        rows = side.count()
        limits[i] = hot_limit(rows, partitions, least)
        known = hot_left if i == 0 else None
        hot[i] = {} if rows <= limits[i] else known if known is not None else hot_keys(side, on, limits[i])
    keys = hot[0].keys() | hot[1].keys()
    if not keys:
        return left.join(right, on, how)
    blocks = lambda i, key: max(1, -(-hot[i].get(key, 0) // limits[i]))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on) + ", _ls int, _rs int"
    cut = left.sparkSession.createDataFrame([(*k, blocks(0, k), blocks(1, k)) for k in keys], schema)

    def block(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        place = F.xxhash64(*[c for c in df.columns if c not in on], F.monotonically_increasing_id())
        df = df.withColumn("_h", place).join(F.broadcast(cut), on, "left")  # fewer rows than twice the partitions
        df = df.withColumn(own_name, F.pmod("_h", F.coalesce(own, F.lit(1))).cast("int"))
        return df.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_h", "_ls", "_rs")

    cut_left = block(left, "_ls", "_rs", "_bl", "_br")
    cut_right = block(right, "_rs", "_ls", "_br", "_bl")
    return cut_left.join(cut_right, [*on, "_bl", "_br"], how).drop("_bl", "_br")
