"""The feed: stored pins first, then external results by topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.paging import clamp, decode_feed_cursor, encode_feed_cursor, list_pins

FEED, FEED_MOST = 30, 50
#: Pages asked of each topic.
PAGES = 16


def feed_items(stored: DataFrame, external: DataFrame) -> DataFrame:
    """The whole feed as one relation (phase, at, key, kind, id): stored pins newest first, then topics page by page.

    An external image that several pages bring is kept where it comes first. Sort by (phase, at) to read it in order.
    """
    pins = stored.select(F.lit(0).alias("phase"), F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c")).alias("at"), F.concat(F.lit("pin:"), F.col("id").cast("string")).alias("key"), F.lit("pin").alias("kind"), F.col("id").cast("string").alias("id"))
    place = F.struct(F.col("topic").cast("bigint").alias("a"), F.col("page").cast("bigint").alias("b"), F.col("place").cast("bigint").alias("c"))
    found = external.groupBy("id").agg(F.min(place).alias("at"))
    found = found.select(F.lit(1).alias("phase"), "at", F.concat(F.lit("px:"), F.col("id").cast("string")).alias("key"), F.lit("result").alias("kind"), F.col("id").cast("string").alias("id"))
    return pins.unionByName(found)


def feed_page(stored: DataFrame, external: DataFrame, cursor: str | None = None, limit: int | None = None, topics: int = 12) -> tuple[DataFrame, str | None]:
    """A page of rows (key, kind, id) and the next cursor, None at the end. A cursor that can't be read is the start.

    external: (topic, page, place, id). The stored pins' pages end before the first external page begins. A topic ends
    at its first empty page or after PAGES; a topic without a first page is passed over.
    """
    n, at = clamp(limit, FEED, FEED_MOST), decode_feed_cursor(cursor)
    if at[0] == "stored":
        page = list_pins(stored, limit=n, cursor=at[1])
        rows = page.rows.select(F.concat(F.lit("pin:"), F.col("id").cast("string")).alias("key"), F.lit("pin").alias("kind"), F.col("id").cast("string").alias("id"))
        more = page.next_cursor()
        return rows, encode_feed_cursor(("stored", more)) if more else encode_feed_cursor(("external", 0, 1))
    _, topic, number = at
    here = (F.col("topic") == topic) & (F.col("page") == number)
    start = external.filter((here | (F.col("topic") > topic) & (F.col("page") == 1)) & (F.col("topic") < topics))
    first = start.agg(F.min(F.struct("topic", "page")).alias("at")).first()["at"]
    if first is None:
        return external.limit(0).select(F.lit("").alias("key"), F.lit("").alias("kind"), F.col("id").cast("string").alias("id")), None
    topic, number = first["topic"], first["page"]
    rows = external.filter((F.col("topic") == topic) & (F.col("page") == number)).orderBy("place").limit(n)
    rows = rows.select(F.concat(F.lit("px:"), F.col("id").cast("string")).alias("key"), F.lit("result").alias("kind"), F.col("id").cast("string").alias("id"))
    after = external.filter((F.col("topic") == topic) & (F.col("page") == number + 1)).limit(1).count() and number < PAGES
    step = (topic, number + 1) if after else (topic + 1, 1)
    return rows, encode_feed_cursor(("external", *step)) if step[0] < topics else None
