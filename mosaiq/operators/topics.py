"""Terms of a set of pins: document frequencies, topics, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.text import document_text, tokens


def document_terms(pins: DataFrame) -> DataFrame:
    """(id, term) once for each term of each pin."""
    return pins.select("id", F.explode(F.array_distinct(tokens(document_text()))).alias("term"))


def document_frequencies(pins: DataFrame) -> DataFrame:
    return document_terms(pins).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def topics(pins: DataFrame, limit: int = 10) -> DataFrame:
    """(term, df, weight): terms in at least two pins and in at most half of them, by df times idf, then by term."""
    total = pins.agg(F.count(F.lit(1)).alias("n"))
    rows = document_frequencies(pins).join(F.broadcast(total))  # one row
    rows = rows.filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.5))))
    rows = rows.withColumn("weight", F.col("df") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    return rows.orderBy(F.desc("weight"), "term").limit(limit).select("term", "df", "weight")


def keywords(pins: DataFrame, limit: int = 3, least_letters: int = 4) -> DataFrame:
    """The terms, of at least four letters after stemming, that most pins have; ties by term."""
    rows = document_frequencies(pins).filter(F.length("term") >= least_letters)
    return rows.orderBy(F.desc("df"), "term").limit(limit)
