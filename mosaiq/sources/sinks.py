"""Writing tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pins(pins: DataFrame, path: str) -> None:
    """Pins as Parquet, a folder a day of creation, in the feed's order within files: a page near the top reads one folder."""
    day = pins.withColumn("day", F.to_date("created_at"))
    day.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions(F.desc("created_at"), F.desc("id")).write.mode("overwrite").partitionBy("day").parquet(path)


def write_report(sections: dict[str, DataFrame], path: str, most: int = 1_000) -> None:
    """A Markdown report of small results, written as text by the executors' file system; a section has at most `most` rows, else it is refused."""
    lines = []
    for title, rows in sections.items():
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{title} has more than {most} rows")
        lines += [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in found] + [""]
    spark = next(iter(sections.values())).sparkSession
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
