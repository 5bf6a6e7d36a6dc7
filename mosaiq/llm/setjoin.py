"""Problem 2: all similar pairs between set-valued records, by a prefix-filtered join."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.classes import member_pairs
from mosaiq.operators import skew
from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch, dense_ids

#: Up to this size every set size is its own size class; above, eight classes a doubling.
FINE = 24


def _ceil(x: Column, over: int) -> Column:
    return F.floor((x + (over - 1)) / F.lit(over)).cast("int")


def _size_class(n: Column) -> Column:
    return F.when(n <= FINE, n).otherwise(F.lit(FINE) + F.floor(8 * F.log2(n / F.lit(float(FINE))))).cast("int")


def _least_size(c: Column) -> Column:
    return F.when(c <= FINE, c).otherwise(F.ceil(FINE * F.pow(F.lit(2.0), (c - FINE) / F.lit(8.0)) - F.lit(1e-6))).cast("int")


def ranked_sets(s: Scratch, classes: DataFrame) -> tuple[DataFrame, int]:
    """(c, r, n, sig) of classes (c, items): the items' ranks, rarest first, their number and a signature of 64 bits; and the most sets that an item is in.

    Bit rank % 64 of the signature is set for each item. An item of one set whose bit isn't set in another's signature isn't
    in that other set.
    """
    rows = classes.select("c", F.explode("items").alias("item"))
    order = dense_ids(s, rows.groupBy("item").agg(F.count(F.lit(1)).alias("df")), ["df", "item"], "rarity", "rank")
    order = s.save(order.select("item", "rank", "df"), "ranks")
    top = order.agg(F.max("df")).first()[0] or 0
    ranks = order.select("item", "rank")
    ranked = rows.join(ranks, "item") if top <= skew.HOT_ROWS else skew_join(s.save(rows, "items"), ranks, ["item"], unique=True)
    bit = F.expr("shiftleft(1L, cast(rank % 64 as int))")
    ranked = ranked.groupBy("c").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.bit_or(bit).alias("sig"))
    ranked = s.save(ranked.withColumn("n", F.size("r")), "ranked")
    s.drop("rarity", "ranks", "items")
    return ranked, top


def similar_classes(s: Scratch, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(ca, cb) for the pairs of distinct sets whose intersection is at least threshold of their union.

    classes: (c, items), each set once, items distinct and without nulls; a table. Sets are sorted by rarity of their
    items. Sets of sizes n >= m reach the threshold p/q only with an overlap of o = ceil(p(n+m) / (p+q)); two such sets
    share an item among the first n-o+1 of the one and m-o+1 of the other. So a set is indexed, for each size a partner may
    have (length filter), under just so many of its rarest items, and meets only partners of that size at fitting
    positions: length and positional filter are part of the join key (item, size, size) and cost no comparison. The
    partner's sizes above FINE are grouped, with bounds that hold for the group; in a set's own group partners may be
    smaller than it on either side of the join. A pair found is dropped at once if the sets' signatures show too many
    items of one that the other lacks; the rest is made distinct and its overlap counted.
    """
    p, q = threshold.numerator, threshold.denominator
    ranked, top = ranked_sets(s, classes)
    n, k = F.col("n"), F.col("k")

    def prefixes(first: Column, last: Column, least: Column, name: str, kn: Column, km: Column) -> DataFrame:
        rows = ranked.withColumn("k", F.explode(F.sequence(first, last)))
        length = F.greatest(F.lit(0), n - _ceil(p * (n + least), p + q) + 1)
        rows = rows.select(F.col("c").alias(name), F.col("n").alias(f"n{name}"), F.col("sig").alias(f"s{name}"), kn.alias("kn"), km.alias("km"), F.explode(F.slice("r", F.lit(1), length)).alias("rank"))
        # item and both size classes (below 256 for any array) in one number: one long to move and to sort by
        rows = rows.select(name, f"n{name}", f"s{name}", F.expr("shiftleft(rank, 16) | shiftleft(cast(kn as bigint), 8) | km").alias("key"))
        return rows if top <= skew.HOT_ROWS else s.save(rows, f"prefixes-{name}")

    own = _size_class(n)
    probe = prefixes(_size_class(_ceil(n * p, q)), own, F.greatest(_least_size(k), _ceil(n * p, q)), "x", own, k)
    least = F.greatest(_least_size(k), F.when(k == own, _ceil(n * p, q)).otherwise(n))
    index = prefixes(own, _size_class(F.floor(n * q / p).cast("int")), least, "y", k, own)

    # no key has more rows than the sets of its item: there is nothing to cut if the most frequent one is in few
    hits = probe.join(index, "key") if top <= skew.HOT_ROWS else skew_join(probe, index, ["key"])
    need = F.ceil(F.lit(p) * (F.col("nx") + F.col("ny")) / F.lit(p + q) - 1e-9)
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
    hits = hits.filter("x <> y and (shiftright(key, 8) & 255 <> key & 255 or x < y)").filter((F.col("nx") - lacks("sx", "sy") >= need) & (F.col("ny") - lacks("sy", "sx") >= need))
    hits = s.save(hits.select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct(), "hits")
    s.drop("prefixes-x", "prefixes-y")
    sets = ranked.select("c", "r")
    hits = s.save(skew_join(hits, sets.toDF("ca", "ra"), ["ca"], unique=True), "hits-half")
    hits = skew_join(hits, sets.toDF("cb", "rb"), ["cb"], unique=True)
    both = F.size(F.array_intersect("ra", "rb"))
    return hits.filter(q * both >= p * (F.size("ra") + F.size("rb") - both)).select("ca", "cb")


def similar_set_classes(sets: DataFrame, threshold: str = "0.7", least: int = 1, *, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """The similar pairs in short: `pairs` (ca, cb) of sets, and `members` (id, c), the ids that have each of these sets.

    sets: (id, items), each id once, items sorted, without nulls and repeats; sets below `least` items, empty ones always,
    take no part. ca = cb stands for a set that several ids have. A class c has a number, without meaning beyond the
    result. The size is that of the distinct sets, however many ids share one. Both are tables of the scratch folder. Ids
    come back to their class by two hashes of the set, 128 bits together, so that sets are moved once only.
    """
    s = scratch or Scratch(sets.sparkSession, "setjoin")
    sets = s.save(sets.filter(F.size("items") >= max(1, least)).select("id", "items"), "sets")
    digest = [F.xxhash64("items").alias("d1"), F.xxhash64(F.lit(1), "items").alias("d2")]
    grouped = sets.groupBy("items").agg(F.count(F.lit(1)).alias("copies"))
    grouped = s.save(grouped.select(F.monotonically_increasing_id().alias("c"), "items", "copies", *digest), "classes")
    pairs = similar_classes(s, grouped.select("c", "items"), Fraction(threshold))
    pairs = s.save(pairs.unionByName(grouped.filter("copies > 1").select(F.col("c").alias("ca"), F.col("c").alias("cb"))), "pairs")
    paired = grouped.select("c", "d1", "d2").join(pairs.select(F.explode(F.array("ca", "cb")).alias("c")).distinct(), "c", "left_semi")
    members = skew_join(sets.select("id", *digest), s.save(paired, "paired"), ["d1", "d2"], unique=True)
    return {"pairs": pairs, "members": s.save(members.select("id", "c"), "members")}


def similar_set_pairs(sets: DataFrame, threshold: str = "0.7", least: int = 1, a: str = "id_a", b: str = "id_b", *, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b, of all ids whose sets overlap in at least threshold (a decimal in (0, 1]) of their union.

    The pairs of similar_set_classes expanded to their ids. For pairs between two tables give the union of both. No pair:
    an empty result.
    """
    s = scratch or Scratch(sets.sparkSession, "setjoin")
    found = similar_set_classes(sets, threshold, least, scratch=s)
    return member_pairs(s, found["pairs"], found["members"], a, b)
