"""Image files. Decoding is Spark's; resizing is by area average, so that pixels are close to, not equal to, those of other libraries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.images import LUMA, resize
from mosaiq.runtime import ship

MOST_BYTES = 25 * 1024 * 1024
GRAY, SAMPLE = 32, 96


def fetchable(url: Column | str) -> Column:
    return (F.col(url) if isinstance(url, str) else url).rlike("^https?://")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files of at most 25 MB; larger ones aren't opened, as the length is pushed to the listing."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= MOST_BYTES).select("path", "length", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of the files that decode; data is rows of b, g, r(, a) bytes."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def rgb_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """height x width x 3 of r, g, b in 0..255; transparency is laid on white, one channel is grey."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return np.repeat(a, 3, 2)
    colour = a[:, :, 2::-1]
    if channels == 4:
        alpha = a[:, :, 3:] / 255
        colour = colour * alpha + 255 * (1 - alpha)
    return colour


def gray_of(data: bytes, width: int, height: int, channels: int) -> list[float]:
    """1,024 grey values of the image stretched to 32 x 32."""
    small = resize(rgb_array(data, width, height, channels), GRAY, GRAY)
    return np.floor(small @ LUMA + 0.5).ravel().tolist()


def samples_of(data: bytes, width: int, height: int, channels: int) -> bytes:
    """Flat r, g, b bytes of the image fitted into 96 x 96, its proportions kept; smaller images stay."""
    scale = min(1.0, SAMPLE / max(width, height))
    to = max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))
    return np.floor(resize(rgb_array(data, width, height, channels), *to) + 0.5).astype(np.uint8).tobytes()


def matrices(images: DataFrame) -> DataFrame:
    """images of read_images with gray and pixels instead of data."""

    ship(images.sparkSession)

    @F.pandas_udf("gray array<double>, pixels binary")
    def reduce(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = list(zip(data, width, height, channels, strict=True))
        return pd.DataFrame({"gray": [gray_of(*r) for r in rows], "pixels": [samples_of(*r) for r in rows]})

    return images.withColumn("_m", reduce.asNondeterministic()("data", "width", "height", "channels")).select("*", "_m.*").drop("_m", "data")
