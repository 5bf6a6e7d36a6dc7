"""Stored tables by name; rows that occur twice are read once, which makes their ids keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.runtime import table

SWATCH = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("g", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("hex", T.StringType()), T.StructField("share", T.DoubleType())])
#: A stored pin. Optional fields are null where they are absent.
PIN = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("id", "title", "image_url", "author_id")) for n in ("id", "title", "description", "image_url", "thumb_url", "author", "author_id")]
    + [T.StructField("created_at", T.TimestampType(), False)]
    + [T.StructField("public_id", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "visibility", "provider", "provider_id", "provider_page_url", "credit")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("phash", T.StringType()), T.StructField("palette", T.ArrayType(SWATCH)), T.StructField("color_families", T.ArrayType(T.StringType())), T.StructField("analyzed_at", T.TimestampType())]
)


def pins(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Pins, rows that repeat one read once; only the named columns are read and shuffled, so name those that are needed.

    Repeated rows are equal in every column, so that all columns are the key: a filter on any of them goes below the
    aggregate and into the scan, which it couldn't if rows were told apart by id alone.
    """
    rows = table(spark, d, "pins")
    if columns:
        rows = rows.select("id", *[c for c in columns if c != "id"])
    return rows.distinct()


def saves(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (user_id, pin_id) without nulls."""
    return table(spark, d, "saves").select("user_id", "pin_id").dropna().distinct()


def comments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "comments")
    if columns:
        rows = rows.select("id", *[c for c in columns if c != "id"])
    return rows.distinct()


def thread(comments_: DataFrame, users: DataFrame, pin_id: str) -> DataFrame:
    """A pin's comments, oldest first, with the author's present name, else the name on the comment, else Someone."""
    names = users.select(F.col("id").alias("author_id"), F.col("name").alias("now_named"))
    rows = comments_.filter(F.col("pin_id") == pin_id).join(names, "author_id", "left")
    return rows.select("id", "pin_id", "body", F.coalesce("now_named", "author", F.lit("Someone")).alias("author"), "author_id", "created_at").orderBy("created_at", "id")


def comment_counts(comments_: DataFrame, by: str = "pin_id") -> DataFrame:
    return comments_.groupBy(by).agg(F.count(F.lit(1)).alias("comments"))


def save_counts(saves_: DataFrame) -> DataFrame:
    return saves_.groupBy("pin_id").agg(F.count(F.lit(1)).alias("saves"))


def saved_flags(pins_: DataFrame, saves_: DataFrame, user: str) -> DataFrame:
    """pins with `saved`: whether the user saved each."""
    mine = saves_.filter(F.col("user_id") == user).select(F.col("pin_id").alias("id"), F.lit(True).alias("saved"))
    return pins_.join(mine, "id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def seed_addresses(pins_: DataFrame, manifest: list[str] | DataFrame, base: str | None) -> DataFrame:
    """pins (public_id, fallback_url) with image_url: the asset's address if the manifest (a list, or a table public_id) has it and there is a base, else the fallback."""
    if isinstance(manifest, DataFrame) and base:
        known = manifest.select("public_id").distinct().withColumn("_there", F.lit(True))
        pins_, there = pins_.join(known, "public_id", "left"), F.col("_there").isNotNull()
        address = F.when(there, F.concat(F.lit(base.rstrip("/") + "/"), "public_id")).otherwise(F.col("fallback_url"))
        return pins_.withColumn("image_url", address).drop("_there")
    there = F.col("public_id").isin(*manifest) if manifest and base else F.lit(False)
    return pins_.withColumn("image_url", F.when(there, F.concat(F.lit((base or "").rstrip("/") + "/"), "public_id")).otherwise(F.col("fallback_url")))
