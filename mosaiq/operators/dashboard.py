"""The numbers of one user's board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.dates import day_key
from mosaiq.operators.colors import family_slices
from mosaiq.operators.duplicates import duplicate_groups, hashed
from mosaiq.operators.popularity import engagement, top_pins
from mosaiq.operators.store import analysis_coverage
from mosaiq.operators.filters import visible_to


def activity(pins: DataFrame, today: str, days: int = 14) -> DataFrame:
    """(day, pins): pins of each of the last days, today among them, 0 where there are none."""
    spine = pins.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    day = day_key("created_at")
    recent = pins.filter((day > F.date_sub(F.lit(today).cast("date"), days)) & (day <= F.lit(today).cast("date")))
    counts = recent.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("pins"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("pins", F.lit(0)).alias("pins")).orderBy("day")


def board_counts(pins: DataFrame, saves: DataFrame, comments: DataFrame, user: str) -> DataFrame:
    """(mine, saved, comments): the user's pins, the pins they saved, the comments on theirs; one row."""
    mine = pins.filter(F.col("author_id") == user)
    n = mine.agg(F.count(F.lit(1)).alias("mine"))
    saved = saves.filter(F.col("user_id") == user).agg(F.countDistinct("pin_id").alias("saved"))
    said = comments.join(mine.select(F.col("id").alias("pin_id")), "pin_id", "left_semi").agg(F.count(F.lit(1)).alias("comments"))
    return n.join(F.broadcast(saved)).join(F.broadcast(said))  # one row each


def duplicate_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.countDistinct("group_id").alias("duplicate_groups"), F.count(F.lit(1)).alias("duplicate_pins"))


def dashboard_stats(pins: DataFrame, saves: DataFrame, comments: DataFrame, swatches: DataFrame, user: str, today: str, threshold: int = 10) -> dict[str, DataFrame]:
    """All parts of the board as separate lazy results.

    Board rows are the user's own pins; coverage and duplicates are over all pins the user may see.
    """
    mine = pins.filter(F.col("author_id") == user)
    own_swatches = swatches.join(mine.select("id"), "id", "left_semi")
    return {
        "counts": board_counts(pins, saves, comments, user),
        "analysis": analysis_coverage(pins, user),
        "duplicates": duplicate_counts(duplicate_groups(hashed(pins.filter(visible_to(user))), threshold, width=False)),
        "activity": activity(mine, today),
        "palette": family_slices(own_swatches),
        "top": top_pins(mine, saves, comments),
        "pins": engagement(mine, saves, comments),
    }
