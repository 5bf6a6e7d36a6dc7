"""Starting data given as literals with ages instead of dates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US, MINUTE_US = 86_400_000_000, 60_000_000


def days_ago(days, now: int):
    """The timestamp that many days (a column, fractions allowed) before `now` in milliseconds."""
    return F.timestamp_micros((F.lit(now * 1000) - days * DAY_US).cast("bigint"))


def minutes_ago(minutes, now: int):
    """The timestamp that many whole minutes (a column) before `now`."""
    return F.timestamp_micros((F.lit(now * 1000) - minutes.cast("bigint") * MINUTE_US).cast("bigint"))


def seed(spark: SparkSession, pins: Iterable[Mapping], users: Iterable[Mapping], saves: Mapping[str, Iterable[str]], comments: Iterable[Mapping], now: int) -> dict[str, DataFrame]:
    """pins (id, title, description, author_id, days_ago), users (id, name), saves {user: pins}, comments (pin_id, author_id, body, minutes_ago) as tables.

    Pins are public and of source seed; comments are numbered in the order given.
    """
    pick = lambda rows, names: [tuple(r.get(n) for n in names) for r in rows]
    p = spark.createDataFrame(pick(pins, ("id", "title", "description", "author_id", "days_ago")), "id string, title string, description string, author_id string, days double")
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(pick(comments, ("pin_id", "author_id", "body", "minutes_ago")))], "id bigint, pin_id string, author_id string, body string, minutes int")
    return {
        "pins": p.select("id", "title", "description", "author_id", days_ago(F.col("days"), now).alias("created_at"), F.lit("public").alias("visibility"), F.lit("seed").alias("source")),
        "users": spark.createDataFrame(pick(users, ("id", "name")), "id string, name string"),
        "saves": spark.createDataFrame([(u, i) for u, ids in saves.items() for i in dict.fromkeys(ids)], "user_id string, pin_id string"),
        "comments": c.select("id", "pin_id", "author_id", "body", minutes_ago(F.col("minutes"), now).alias("created_at")),
    }
