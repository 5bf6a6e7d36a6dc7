"""Near-duplicate hashes: probe, pairs and single-linkage groups."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.hashing import classify, hamming, hash_bits, is_hash
from mosaiq.operators.filters import visible_to
from mosaiq.operators import skew
from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch

#: Rows to which one task expands hashes, to all values within a radius of their bands.
PER_TASK = 1_500_000
#: The largest number of values around one band that is written out as a literal.
MOST_PROBES = 2_000


def near_duplicates_of(pins: DataFrame, phash: str, *, threshold: int = 10, exclude=None, limit: int | None = None) -> DataFrame:
    """Rows of pins (id, phash, ...) within threshold bits of one hash, nearest first, then by id; with distance and verdict.

    One scan without a shuffle. Rows without a valid hash are passed over; a limit of None or 0 keeps all.
    """
    probe = int(phash, 16)
    probe -= (1 << 64) * (probe >> 63)
    rows = pins.withColumn("distance", hamming(hash_bits("phash"), F.lit(probe).cast("long"))).filter(F.col("distance") <= threshold)
    if exclude is not None:
        rows = rows.filter(F.col("id") != exclude)
    rows = rows.withColumn("verdict", classify(F.col("distance"))).orderBy("distance", "id")
    return rows.limit(limit) if limit else rows


def duplicate_guard(pins: DataFrame, phash: str, viewer: str | None = None, threshold: int = 10) -> DataFrame:
    """The nearest visible pin within the threshold of a new image's hash; no row if the image is new."""
    return near_duplicates_of(pins.filter(visible_to(viewer)), phash, threshold=threshold, limit=1)


def _band_plan(threshold: int, hashes: int = 1 << 16) -> list[tuple[int, int, int]]:
    """(shift, width, radius) with the sum of radius + 1 over the bands equal to threshold + 1: one band is within its radius.

    Few wide bands compare few pairs but need many probes a hash, many narrow ones the other way round. Of 1 to threshold + 1
    bands, the plan is that of the least rows in all for so many random hashes: probes and pairs to be compared.
    """
    plans = []
    for count in range(1, min(threshold + 1, 32) + 1):
        more, spare = divmod(threshold + 1 - count, count)
        widths = [64 // count + (i < 64 % count) for i in range(count)]
        plan = [(sum(widths[:i]), w, min(w, more + (i >= count - spare))) for i, w in enumerate(widths)]  # the larger radii to the narrower bands
        probes = [sum(comb(w, k) for k in range(r + 1)) for _, w, r in plan]
        if max(probes) <= MOST_PROBES:
            plans.append((sum(probes) + hashes * sum(n / 2.0**w for n, (_, w, _) in zip(probes, plan, strict=True)), plan))
    return min(plans, key=lambda x: x[0])[1]


def _band(h: Column | str, shift: int, width: int) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return h if width == 64 else F.shiftrightunsigned(h, shift).bitwiseAND((1 << width) - 1)


def _around(band: int, value: Column, flips: list[int]) -> Column:
    """(band, v) for every v that differs from value by one of flips; these are one literal, so that code stays small."""
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(x).alias("v")))


def near_hashes(hashes: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance), a < b, for the distinct 64-bit numbers in column h of hashes that differ in at most threshold bits.

    The hash is cut into bands; two near hashes are within a band's radius in at least one of them (pigeonhole), so one
    side is put under its own band value and the other under every value within the radius. Pairs are emitted by the
    first band that finds them, which needs no distinct. The bands are sized to the number of hashes.
    """
    s = Scratch(hashes.sparkSession, "near")
    distinct = s.save(hashes.filter("h is not null").select("h").distinct(), "distinct")
    number = distinct.count()
    plan = _band_plan(threshold, number)
    own, near = [], []
    for i, (shift, width, radius) in enumerate(plan):
        value = _band("h", shift, width)
        own.append(F.struct(F.lit(i).alias("band"), value.alias("v")))
        flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        near.append(_around(i, value, flips))
    stored = s.save(distinct.select(F.col("h").alias("b"), F.explode(F.array(*own)).alias("at")).select("b", "at.*"), "stored")
    spread = distinct.repartition(-(-number * sum(comb(w, k) for _, w, r in plan for k in range(r + 1)) // PER_TASK) or 1, "h")
    probes = s.save(spread.select(F.col("h").alias("a"), F.explode(F.concat(*near)).alias("at")).select("a", "at.*"), "probes")
    found = skew_join(probes, stored, ["band", "v"]).filter("a < b").withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= threshold)
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(plan))
    for i, (shift, width, radius) in reversed(list(enumerate(plan))):
        first = F.when(F.bit_count(_band(x, shift, width)) <= radius, i).otherwise(first)
    return found.filter(F.col("band") == first).select("a", "b", "distance")


def hashed(pins: DataFrame) -> DataFrame:
    """(id, h) of the rows with a valid hash."""
    return pins.filter(F.col("id").isNotNull() & is_hash("phash")).select("id", hash_bits("phash").alias("h"))


def duplicate_pairs(items: DataFrame, threshold: int = 10) -> DataFrame:
    """(a, b, distance, verdict), a < b, for the ids of items (id, h) whose hashes differ in at most threshold bits.

    Distinct hashes are compared, then expanded to their ids. Ids must be distinct.
    """
    s = Scratch(items.sparkSession, "pairs")
    items = s.save(items.select("id", "h").filter("h is not null"), "items")
    pairs = near_hashes(items, threshold)
    same = items.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("distance"))
    pairs = s.save(pairs.unionByName(same), "hash-pairs")
    half = s.save(skew_join(pairs, items.select(F.col("id").alias("x"), F.col("h").alias("a")), ["a"]), "half")
    both = skew_join(half, items.select(F.col("id").alias("y"), F.col("h").alias("b")), ["b"]).filter("a <> b or x < y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance", classify(F.col("distance")).alias("verdict"))


def components(links: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that id is connected with, over links (a, b). Ids without links don't appear.

    Alternating large and small stars: in turn every node ties its larger neighbours, and itself and its smaller ones, to the smallest node
    around it, until nothing changes. Each turn is written to the shared folder; the number of edges never grows. A node
    with a large part of the edges is cut into blocks, as it is the key of joins.
    """
    s = Scratch(links.sparkSession, "components")
    edges = s.save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "e0")
    turn, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        several = edges.count() > skew.HOT_ROWS  # else no node can be hot, and its edges needn't be written for a second look
        both = s.save(both, f"b{turn}") if several else both
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = skew_join(both, s.save(least, f"m{turn}"), ["u"], unique=True) if several else both.join(least, "u")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = s.save(large, f"g{turn}")
        small = skew_join(large, large.groupBy("u").agg(F.min("v").alias("m")), ["u"], unique=True)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = s.save(small, f"e{turn + 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        s.drop(*[f"{x}{turn}" for x in "ebmg"])
        if now == before:
            break
        before, turn = now, turn + 1
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def duplicate_groups(items: DataFrame, threshold: int = 10, *, width: bool = True) -> DataFrame:
    """(group_id, id, size, max_distance): single-linkage groups of items (id, h), named by their smallest id.

    A group's largest distance is taken over the distances of all its distinct hashes, also those not linked directly;
    width=False leaves it out, as it alone takes time quadratic in a group's number of distinct hashes; large groups are
    cut into blocks, which meet in many tasks.
    """
    s = Scratch(items.sparkSession, "groups")
    items = s.save(items.select("id", "h").filter("h is not null"), "items")
    links = near_hashes(items, threshold)
    grouped = s.save(components(links), "hash-groups").select(F.col("id").alias("h"), "group_id")
    member = s.save(skew_join(items, grouped, ["h"], "left", unique=True).withColumn("g", F.coalesce("group_id", "h")).select("id", "h", "g"), "members")
    sizes = member.groupBy("g").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    if width:
        own = s.save(member.select("g", "h").distinct(), "own")
        wide = skew_join(own, own.select("g", F.col("h").alias("o")), ["g"]).groupBy("g").agg(F.max(hamming(F.col("h"), F.col("o"))).alias("max_distance"))
        sizes = sizes.join(wide, "g")
    out = ["group_id", "id", "size", *(["max_distance"] if width else [])]
    return skew_join(member, s.save(sizes, "sizes"), ["g"], unique=True).select(*out)
