"""Comments as a stream: one pin's live thread, counts by window, and analysis of new pins in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mosaiq.operators.images import analyze

SCHEMA = "id bigint, pin_id string, body string, author string, author_id string, created_at timestamp"


def read_comments(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files of comments as a stream; new files are new comments."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def accepted(comments: DataFrame, most: int = 1000) -> DataFrame:
    """Comments with a body of 1 to 1,000 characters after trimming of white space."""
    body = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    return comments.filter(F.length(body).between(1, most)).withColumn("body", body)


def new_comments(rows: DataFrame) -> DataFrame:
    """Stored comments from what was typed (pin_id, body, author, author_id), a batch or a stream; those that `accepted` refuses are left out.

    An id is the microseconds now and a random number, both in hexadecimal, as one number of 63 bits; the time is now.
    """
    now = F.current_timestamp()
    made = F.shiftleft(F.unix_micros(now).bitwiseAND((1 << 43) - 1), 20).bitwiseOR(F.floor(F.rand() * (1 << 20)).cast("bigint"))
    return accepted(rows).select(made.alias("id"), "pin_id", "body", "author", "author_id", now.alias("created_at"))


def live_thread(comments: DataFrame, pin_id: str, late: str = "30 days") -> DataFrame:
    """A pin's comments, each id once within the time that comments may be late; state is kept no longer than that."""
    return comments.filter(F.col("pin_id") == pin_id).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(comments: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, pin_id, comments) for each window and pin, rows that occur twice counted once; distinct ids are not assumed.

    There is no watermark: a comment counts however late it comes, and its window comes out again with the new count. So
    run it in complete mode (counts_to) or update mode, where the latest count of a window and pin holds. The price is
    state that grows with the comments, an id, pin and time each.
    """
    timed = comments.select("id", "pin_id", "created_at").dropDuplicates()
    return timed.groupBy(F.window("created_at", window).alias("w"), "pin_id").agg(F.count(F.lit(1)).alias("comments")).select(F.col("w.start").alias("start"), "pin_id", "comments")


def publish(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to a listener. A listener's failure stops the query, which goes on from its checkpoint; batches are numbered, so that a listener can pass over one it has had."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet folder, each row once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_to(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keeps a Parquet folder at the latest of all counts, those of windows still open too: each micro-batch writes it anew."""


    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("complete")
    return (writer.trigger(availableNow=True) if once else writer).start()


def analyse_new(images: DataFrame, store: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Analyses new images (id, gray, pixels) micro-batch by micro-batch and hands (id, phash, palette, analyzed_at) to store.

    Every image of a batch is stamped, also one that couldn't be analysed, so that it isn't tried forever.
    """


    def handle(batch: DataFrame, number: int) -> None:
        store(analyze(batch).select("id", "phash", "palette", F.current_timestamp().alias("analyzed_at")))

    return publish(images, handle, checkpoint, once=True)
