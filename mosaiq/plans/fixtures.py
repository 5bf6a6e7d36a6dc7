"""Relations made of the driver's tables where these have no table of their own: hashes, palettes, images, external results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.hashing import block_hash, is_hash
from mosaiq.operators.images import dct_basis
from mosaiq.runtime import ship, table

#: 2025-01-01 00:00:00 UTC in milliseconds, the clock of all queries.
NOW = 1_735_689_600_000
AUTHOR = "kasimir.tarnow3@users.invalid"


def vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, h): the embeddings' vectors hashed like a block of 64 coefficients."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", block_hash("embedding").alias("h"))


def swatches(spark: SparkSession, d: str) -> DataFrame:
    """(id, pos, r, g, b, share): five colours an embedding, shares falling."""
    channel = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.element_at("embedding", 3 * F.col("pos") + i).cast("double")))).cast("int")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    return rows.select("id", "pos", channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"), ((5 - F.col("pos")) / F.lit(15.0)).alias("share"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """(id, author, tags, width, height) of parts: words of the name, brand and type as tags."""
    tags = F.concat(F.split("p_name", " "), F.array(F.lower("p_brand"), F.lower("p_type")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("author"), tags.alias("tags"), (F.col("p_size") * 10).alias("width"), ((F.col("p_partkey") % 7 + 1) * 50).alias("height"))


def images(spark: SparkSession, d: str, side: int = 32) -> DataFrame:
    """(id, width, height, gray, pixels): a smooth square picture from each embedding, the sum of its low frequencies."""

    ship(spark)

    @F.pandas_udf("gray array<double>, pixels binary")
    def draw(vectors: pd.Series) -> pd.DataFrame:
        c = dct_basis(side)[:8]
        gray = np.clip(128 + 400 * (c.T @ np.stack([np.asarray(v, float) for v in vectors]).reshape(-1, 8, 8) @ c), 0, 255)
        rgb = np.stack([gray, gray.transpose(0, 2, 1), 255 - gray], 3).astype(np.uint8)
        return pd.DataFrame({"gray": list(gray.reshape(len(gray), -1)), "pixels": [x.tobytes() for x in rgb]})

    # one small file would be one task: vectors are spread before they become pictures
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism, "vec_id")
    drawn = vectors.select(F.col("vec_id").alias("id"), F.lit(side).alias("width"), F.lit(side).alias("height"), draw.asNondeterministic()("embedding").alias("m"))
    return drawn.select("id", "width", "height", "m.*")


def pin_swatches(pins: DataFrame) -> DataFrame:
    """(id, pos, r, g, b, share): two colours a pin with a valid hash, three bytes of it each."""
    rows = pins.filter(is_hash("phash")).select("id", "phash", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    channel = lambda i: F.conv(F.substring("phash", 6 * F.col("pos") + 2 * i + 3, F.lit(2)), 16, 10).cast("int")
    return rows.select("id", "pos", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.when(F.col("pos") == 0, 0.75).otherwise(0.25).alias("share"))


def external(spark: SparkSession, d: str) -> DataFrame:
    """(topic, page, place, id): parts as results of twelve topics, a part in two topics."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.col("p_partkey") % 12, F.col("p_size").cast("bigint") % 12)).alias("topic"))
    return rows.select("topic", (F.col("id") % 5 + 1).alias("page"), F.col("id").alias("place"), "id")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers of an image search: parts with untidy comma-separated tags."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.lit("https://example.invalid/").alias("pageURL"), F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " , "), F.lit(",,"), F.upper("p_name"), F.lit(",")).alias("tags"),
        F.lit("t").alias("previewURL"), F.lit("w").alias("webformatURL"), F.lit("l").alias("largeImageURL"), F.col("p_size").alias("imageWidth"), F.col("p_size").alias("imageHeight"), F.col("p_brand").alias("user"),
    )
