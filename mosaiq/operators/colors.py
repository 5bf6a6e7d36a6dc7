"""Search by colour over palettes: rows (id, pos, r, g, b, share), one a swatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import color as C

CUTOFF, LEAST = 60.0, 0.04


def rank_by_color(swatches: DataFrame, target: tuple[int, int, int], *, limit: int | None = None) -> DataFrame:
    """(id, score, closest_hex, closest_share, closest_delta): share-weighted closeness of a palette to the target, best first.

    A swatch counts share * (1 - difference / 60) below a difference of 60. The closest swatch is the first of the least
    difference. Scores below 0.04 are left out. The target's CIELAB values are literals; a palette is one group of at
    most a dozen rows. Ties by id in binary order.
    """
    delta = F.round(C.delta_e(C.to_lab(C.rgb("r", "g", "b")), C.Lab(*[F.lit(x) for x in C.lab_of(*target)])), 9)
    rows = swatches.select("id", "pos", C.to_hex(C.rgb("r", "g", "b")).alias("hex"), "share", delta.alias("delta"))
    gain = F.when(F.col("delta") < CUTOFF, F.col("share") * (1 - F.col("delta") / CUTOFF)).otherwise(0.0)
    out = rows.groupBy("id").agg(F.sum(gain).alias("score"), F.min(F.struct("delta", "pos", "hex", "share")).alias("c")).filter(F.col("score") >= LEAST)
    out = out.select("id", "score", F.col("c.hex").alias("closest_hex"), F.col("c.share").alias("closest_share"), F.col("c.delta").alias("closest_delta"))
    out = out.orderBy(F.desc(F.round("score", 9)), "id")
    return out.limit(limit) if limit else out


def with_families(swatches: DataFrame, families: list[str] | None) -> DataFrame:
    """Swatches of the palettes that have one of the families; all without a filter."""
    if families is None:
        return swatches
    named = swatches.filter(C.family(C.rgb("r", "g", "b")).isin(*families)).select("id").distinct()
    return swatches.join(named, "id", "left_semi")


def family_slices(swatches: DataFrame) -> DataFrame:
    """(family, label, swatch, pins, weight): pins with a family and its average share over all palettes, largest first."""
    named = swatches.withColumn("family", C.family(C.rgb("r", "g", "b")))
    total = swatches.agg(F.countDistinct("id").alias("n"))
    by = named.groupBy("family").agg(F.countDistinct("id").alias("pins"), F.sum("share").alias("w")).join(F.broadcast(total))  # one row
    labels = swatches.sparkSession.createDataFrame(list(C.FAMILIES), "family string, label string, swatch string")
    out = by.join(F.broadcast(labels), "family").select("family", "label", "swatch", "pins", (F.col("w") / F.col("n")).alias("weight"))
    return out.orderBy(F.desc("weight"), "family")


def palette_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, drift): the largest difference from a swatch of a to the nearest of b, palette by palette."""
    lab = lambda df, p: df.select("id", F.col("pos").alias(f"{p}pos"), *[x.alias(f"{p}{n}") for n, x in zip("lab", C.to_lab(C.rgb("r", "g", "b")), strict=True)])
    both = lab(a, "x").join(lab(b, "y"), "id")
    delta = C.delta_e(C.Lab(*[F.col(f"x{n}") for n in "lab"]), C.Lab(*[F.col(f"y{n}") for n in "lab"]))
    return both.groupBy("id", "xpos").agg(F.min(delta).alias("d")).groupBy("id").agg(F.max("d").alias("drift"))
