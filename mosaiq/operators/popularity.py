"""Popularity: three points a save, one a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.filters import in_window
from mosaiq.runtime import Scratch, dense_ids

SAVE_WEIGHT, COMMENT_WEIGHT = 3, 1


def engagement(pins: DataFrame, saves: DataFrame, comments: DataFrame) -> DataFrame:
    """pins with saves, comments and score. Both sides are counted before the join, so that neither multiplies the other."""
    s = saves.filter(F.col("pin_id").isNotNull() & F.col("user_id").isNotNull()).groupBy(F.col("pin_id").alias("id")).agg(F.countDistinct("user_id").alias("saves"))
    c = comments.filter(F.col("pin_id").isNotNull()).groupBy(F.col("pin_id").alias("id")).agg(F.count(F.lit(1)).alias("comments"))
    out = pins.join(s, "id", "left").join(c, "id", "left").withColumns({"saves": F.coalesce("saves", F.lit(0)), "comments": F.coalesce("comments", F.lit(0))})
    return out.withColumn("score", SAVE_WEIGHT * F.col("saves") + COMMENT_WEIGHT * F.col("comments"))


def rank_by_popularity(pins: DataFrame, saves: DataFrame, comments: DataFrame, *, window: str = "all", now: int = 0, limit: int | None = None) -> DataFrame:
    """Pins posted within the window, ranked 1, 2, 3... by score, then newest, then id falling; pins without a point too.

    With a limit only that many rows are gathered to be numbered. Without one, rows are range-partitioned by the order,
    and a row's number is that of the rows in the partitions before and its place in its own.
    """
    inside = in_window(window, now)
    rows = engagement(pins if inside is None else pins.filter(inside), saves, comments)
    order = [F.desc("score"), F.desc("created_at"), F.desc("id")]
    if limit is None:
        return dense_ids(Scratch(pins.sparkSession, "popularity"), rows, order, "ranked", "rank").withColumn("rank", F.col("rank") + 1)
    rows = rows.orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leaderboard_totals(pins: DataFrame, saves: DataFrame, comments: DataFrame, *, window: str = "all", now: int = 0) -> DataFrame:
    inside = in_window(window, now)
    rows = engagement((pins if inside is None else pins.filter(inside)).select("id"), saves, comments)
    return rows.agg(F.coalesce(F.sum("saves"), F.lit(0)).alias("saves"), F.coalesce(F.sum("comments"), F.lit(0)).alias("comments"))


def top_pins(pins: DataFrame, saves: DataFrame, comments: DataFrame, limit: int = 5) -> DataFrame:
    return engagement(pins, saves, comments).filter("score > 0").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(limit)
