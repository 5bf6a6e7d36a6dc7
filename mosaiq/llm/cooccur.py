"""Problem 3: items that appear together, by an external sort of packed pair codes."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch, dense_ids, ship


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums n over runs of equal code in batches sorted by code; a run may go on over batches."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        codes, sums = code[starts], np.add.reduceat(n, starts)
        if last is not None:
            if codes[0] == last:
                sums[0] += held
            else:
                codes, sums = np.concatenate(([last], codes)), np.concatenate(([held], sums))
        last, held = codes[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held], pa.int64())], names=["code", "n"])


def cooccurring_items(sets: DataFrame, *, least: int = 1, share: str = "0", lift: str = "0", scratch: Scratch | None = None) -> DataFrame:
    """Pairs of items that occur in the same set, with counts, lift and odds ratio.

    sets: (id, items), each id once, items distinct and without nulls; empty sets don't count. Result: item_a < item_b
    in binary order, n_a, n_b, n_ab, n_sets, lift = n_ab * n_sets / (n_a * n_b), and odds_ratio of the 2x2 table with one
    half added to each cell, which keeps it finite. Pairs are kept with n_ab >= least, n_ab >= share * n_sets and
    n_ab * n_sets >= lift * n_a * n_b, compared exactly. No pair, or no set: an empty result.

    An item in fewer sets than a pair needs can't be in such a pair and gets no code. The others get their rank in
    binary order, and a pair the 64-bit code rank_a << 32 | rank_b. Codes are sorted within each input partition (Spark's
    sorter spills sorted runs and merges them), counted as run lengths, and only one row a code and partition is
    shuffled; there they are sorted and merged once more. A frequent pair so costs each reducer at most one row from each
    input partition. Pairs are made row by row, never as an array of all pairs of a set.
    """
    ship(sets.sparkSession)
    s = scratch or Scratch(sets.sparkSession, "cooccur")
    sets = s.save(sets.filter(F.size("items") > 0), "sets")
    total = sets.count()
    part, ratio = Fraction(share), Fraction(lift)
    need = max(1, least, -(-part.numerator * total // part.denominator))
    rows = s.save(sets.select("id", F.explode("items").alias("item")), "rows")
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= need)
    items = s.save(dense_ids(s, counts, ["item"], "items", "rank"), "ranked")
    s.drop("items")
    if items.count() >= 1 << 31:
        raise ValueError("more than 2^31 items: the pair code has 32 bits for each")
    coded = skew_join(rows, items.select("item", "rank"), ["item"], unique=True)
    coded = s.save(coded.groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("r")).filter(F.size("r") > 1).select("r"), "coded")
    s.drop("sets", "rows")
    left = coded.select("r", F.posexplode("r").alias("pos", "x")).filter(F.col("pos") < F.size("r") - 1)
    pairs = left.select("x", F.explode(F.slice("r", F.col("pos") + 2, F.size("r"))).alias("y"))
    codes = pairs.select(F.shiftleft("x", 32).bitwiseOR(F.col("y")).alias("code"), F.lit(1).cast("long").alias("n"))
    kind = "code long, n long"
    runs = codes.sortWithinPartitions("code").mapInArrow(run_lengths, kind)
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(run_lengths, kind).filter(F.col("n") >= need)
    merged = s.save(merged.select(F.shiftright("code", 32).alias("ra"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("rb"), F.col("n").alias("n_ab")), "merged")
    s.drop("coded")
    merged = s.save(skew_join(merged, items.select(F.col("rank").alias("ra"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), ["ra"], unique=True), "merged-a")
    merged = skew_join(merged, items.select(F.col("rank").alias("rb"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), ["rb"], unique=True)
    wide = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else F.lit(c).cast("decimal(19,0)")
    if ratio:
        kept = wide("n_ab") * wide(total) * F.lit(ratio.denominator) >= wide("n_a") * wide("n_b") * F.lit(ratio.numerator)
        merged = merged.filter(kept)
    ab, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n_sets"))
    merged = merged.withColumn("n_sets", F.lit(total).cast("long"))
    odds = (ab + 0.5) * (n - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    return merged.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_sets", (ab * n / (a * b)).alias("lift"), odds.alias("odds_ratio"))
