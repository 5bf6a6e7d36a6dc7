"""How well a distance threshold tells edited copies from other images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.hashing import hamming
from mosaiq.operators.colors import palette_drift


def distance_counts(distances: DataFrame) -> DataFrame:
    """(positive, distance, n) of rows (positive, distance). All that follows needs only this: at most 2 * 65 rows."""
    return distances.groupBy("positive", "distance").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(distances: DataFrame, most: int = 20) -> DataFrame:
    """(threshold, tp, fn, fp, precision, recall, f1) for 0..most; 0/0 is 1 for precision and recall, 0 for f1.

    distances: (positive, distance), positive for a pair of copies. They are counted once by distance, and thresholds meet
    the counts, not the pairs.
    """
    steps = distances.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("threshold"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    within = F.col("distance") <= F.col("threshold")
    rows = steps.join(F.broadcast(distance_counts(distances)), F.lit(True), "left").groupBy("threshold")  # at most 130 rows
    rows = rows.agg(n(F.col("positive") & within).alias("tp"), n(F.col("positive") & ~within).alias("fn"), n(~F.col("positive") & within).alias("fp"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.nullif(b, F.lit(0)))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold of the best f1."""
    return sweep.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)


def last_perfect_precision(sweep: DataFrame) -> DataFrame:
    """The last threshold without a false positive; the first of all if there is none."""
    return sweep.agg(F.coalesce(F.max(F.when(F.col("fp") == 0, F.col("threshold"))), F.min("threshold")).alias("threshold"))


def _pick(values: DataFrame, by: list[str], value: str, place) -> DataFrame:
    """The value at 0-based `place` (a function of the row count) of each group's sorted values, from counts of equal values."""


    counted = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    counted = counted.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    at = place(F.col("_all"))
    return counted.filter((F.col("_to") > at) & (F.col("_to") - F.col("_n") <= at)).select(*by, value)


def percentile(values: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The value at index floor(n * p), n - 1 at most, of the sorted values; no interpolation. Equal values are counted first."""
    by = by or []
    keys = by or ["_one"]
    rows = values if by else values.withColumn("_one", F.lit(1))
    out = _pick(rows, keys, value, lambda n: F.least(n - 1, F.floor(n * p)))
    return out if by else out.drop("_one")


def group_stats(values: DataFrame, group: str, value: str = "distance", caught: int = 10) -> DataFrame:
    """(group, min, median, max, caught, total); the median is the upper one of an even number."""
    rows = values.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value) <= caught).alias("caught"), F.count(value).alias("total"))
    return rows.join(_pick(values, [group], value, lambda n: F.floor(n / 2)).withColumnRenamed(value, "median"), group)


def kmeans_stats(runs: DataFrame, others: DataFrame) -> DataFrame:
    """(mean_iterations, mean_drift, max_drift), one row: how long k-means runs, and how far its palettes depend on the seed.

    Both have id and palette, each id once, by different seeds; runs also iterations. The drift of an image is the largest
    difference from a swatch of its run to the nearest of the other. Images without a palette don't count.
    """
    swatches = lambda df: df.select("id", F.posexplode("palette").alias("pos", "s")).select("id", "pos", "s.r", "s.g", "s.b")
    drift = palette_drift(swatches(runs), swatches(others)).agg(F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"))
    return runs.filter("palette is not null").agg(F.avg("iterations").alias("mean_iterations")).crossJoin(drift)


#: An evaluation's originals are a fixed set; up to this number it is broadcast, above it is joined in blocks of about as many.
MOST_ORIGINALS = 10_000


def labelled_distances(samples: DataFrame, originals: DataFrame, truth: str = "pin_id") -> DataFrame:
    """The columns of samples with original_id, positive and distance: every sample against every original but itself.

    samples: (id, h, truth, ...); originals: (id, h, truth). A pair is positive if both have the same truth. This
    is quadratic by definition, a stated set of originals against all samples, so their number is counted before they are
    broadcast. More than MOST_ORIGINALS are cut into blocks, and samples into pieces; every block meets every piece in a
    join by the two numbers, so that a task holds one block.
    """
    blocks = -(-originals.count() // MOST_ORIGINALS)
    o = originals.select(F.col("id").alias("original_id"), F.col("h").alias("_h"), F.col(truth).alias("_truth"))
    if blocks <= 1:
        rows = samples.join(F.broadcast(o), F.col("id") != F.col("original_id"))
    else:
        pieces = max(blocks, samples.sparkSession.sparkContext.defaultParallelism)
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        o = o.withColumn("_block", part("original_id", blocks)).withColumn("_piece", every(pieces))
        rows = samples.withColumn("_piece", part("id", pieces)).withColumn("_block", every(blocks)).join(o, ["_block", "_piece"])
        rows = rows.filter(F.col("id") != F.col("original_id")).drop("_block", "_piece")
    return rows.withColumn("positive", F.col(truth) == F.col("_truth")).withColumn("distance", hamming(F.col("h"), F.col("_h"))).drop("_h", "_truth")
