"""Dates and ages. The clock is always a parameter, in milliseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
UNITS = (("year", 365 * DAY_MS), ("month", 30 * DAY_MS), ("day", DAY_MS), ("hour", 3_600_000), ("minute", 60_000))
# The words English uses instead of a number, by unit and distance.
WORDS = {
    ("year", -1): "last year", ("year", 0): "this year", ("year", 1): "next year",
    ("month", -1): "last month", ("month", 0): "this month", ("month", 1): "next month",
    ("day", -1): "yesterday", ("day", 0): "today", ("day", 1): "tomorrow",
    ("hour", 0): "this hour", ("minute", 0): "this minute",
}


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a timestamp, with or without zone; one without is read as UTC when the session's zone is UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(ts.cast("timestamp"))


def time_ago(ms: Column, now: int) -> Column:
    """3 minutes ago, in 2 days, yesterday; below a minute: just now. Halves are rounded up."""
    elapsed = ms - F.lit(now)
    out = F.lit("just now")
    for unit, length in reversed(UNITS):
        n = F.floor(elapsed / length + 0.5).cast("long")
        named = F.lit(None).cast("string")
        for (u, value), word in WORDS.items():
            if u == unit:
                named = F.when(n == value, word).otherwise(named)
        many = F.concat(F.abs(n).cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        text = F.coalesce(named, F.when(n < 0, F.concat(many, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), many)))
        out = F.when(F.abs(elapsed) >= length, text).otherwise(out)
    return out


def recency(ms: Column, now: int, half_life_days: float = 30.0) -> Column:
    """1 for now or later, one half after half_life_days."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - ms) / F.lit(float(DAY_MS)))
    return F.pow(F.lit(0.5), age / half_life_days)


def day_key(ts: Column | str) -> Column:
    """The calendar day, under the session's time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts.cast("timestamp"))
