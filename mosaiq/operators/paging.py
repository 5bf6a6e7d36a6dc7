"""Keyset pages: newest first, id falling, one row more than asked for tells whether there is a next page."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.dates import epoch_ms
from mosaiq.operators.filters import after, every, visible_to

PAGE, MOST, ALL = 24, 100, 500


def encode_cursor(ms: int, row_id) -> str:
    return base64.urlsafe_b64encode(f"{ms}.{row_id}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[int, str] | None:
    """(ms, id), split at the first dot; None for anything that isn't a cursor."""
    try:
        ms, dot, row_id = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)).decode().partition(".")
        return (int(ms), row_id) if ms and dot and row_id else None
    except (ValueError, UnicodeDecodeError):
        return None


def encode_feed_cursor(position: tuple) -> str:
    """("stored", cursor) or ("external", topic, page)."""
    return f"d.{position[1]}" if position[0] == "stored" else f"p.{position[1]}.{position[2]}"


def decode_feed_cursor(cursor: str | None) -> tuple:
    """Anything that can't be read is the start of the feed."""
    kind, _, rest = (cursor or "").partition(".")
    if kind == "d":
        return ("stored", rest or None)
    topic, _, page = rest.partition(".")
    if kind == "p" and topic.isdigit() and page.isdigit() and int(page) > 0:
        return ("external", int(topic), int(page))
    return ("stored", None)


def cursors(rows: DataFrame, created: str = "created_at", id_col: str = "id") -> DataFrame:
    """rows with `cursor`, the cursor of the page behind each row, as encode_cursor makes it."""
    plain = F.concat(epoch_ms(created).cast("string"), F.lit("."), F.col(id_col).cast("string"))
    return rows.withColumn("cursor", F.translate(F.rtrim(F.base64(plain.cast("binary")), F.lit("=")), "+/\r\n", "-_"))


def read_cursors(rows: DataFrame, cursor: str = "cursor") -> DataFrame:
    """rows with `cursor_ms` and `cursor_id`, both null for anything that isn't a cursor."""
    text = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string")
    ms = F.expr("try_cast(_found as bigint)")
    rows = rows.withColumn("_text", text).withColumn("_found", F.regexp_extract("_text", r"(?s)^(-?[0-9]+)\.(.+)\z", 1))
    rows = rows.withColumn("cursor_ms", ms).withColumn("cursor_id", F.when(F.col("cursor_ms").isNotNull(), F.regexp_extract("_text", r"(?s)^(-?[0-9]+)\.(.+)\z", 2)))
    return rows.drop("_text", "_found")


def clamp(limit: int | None, default: int = PAGE, most: int = MOST) -> int:
    return max(1, min(most, default if limit is None else int(limit)))


def newest(rows: DataFrame, limit: int | None = None, created: str = "created_at", id_col: str = "id") -> DataFrame:
    """A top-k (one pass, limit rows a partition); without a limit, a sort."""
    ordered = rows.orderBy(F.col(created).desc(), F.col(id_col).desc())
    return ordered if limit is None else ordered.limit(limit)


@dataclass
class Page:
    rows: DataFrame
    fetched: DataFrame
    limit: int
    created: str
    id_col: str

    def next_cursor(self) -> str | None:
        """Runs the page: its last row's cursor, if a row comes after it."""
        found = self.fetched.select(epoch_ms(self.created).alias("ms"), F.col(self.id_col).alias("id")).collect()
        return encode_cursor(found[self.limit - 1]["ms"], found[self.limit - 1]["id"]) if len(found) > self.limit else None


def list_pins(pins: DataFrame, *, limit: int | None = None, cursor: str | None = None, author: str | None = None, viewer: str | None = None, created: str = "created_at", id_col: str = "id", id_type=str) -> Page:
    """A page of the pins the viewer may see. A cursor that can't be read gives the first page.

    pins need id, created, author_id and visibility columns; rows with null in created come last.
    """
    n, at = clamp(limit), decode_cursor(cursor)
    try:
        behind = after(at[0], id_type(at[1]), created, id_col) if at else None
    except ValueError:
        behind = None
    mine: Column | None = F.col("author_id") == author if author is not None else None
    fetched = newest(pins.filter(every(visible_to(viewer), mine, behind)), n + 1, created, id_col)
    return Page(fetched.limit(n), fetched, n, created, id_col)


def list_all_pins(pins: DataFrame, *, viewer: str | None = None, author: str | None = None, limit: int = ALL) -> DataFrame:
    return newest(pins.filter(every(visible_to(viewer), F.col("author_id") == author if author is not None else None)), limit)
