"""Perceptual hashes: 16 hex digits on the outside, a 64-bit number within."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = r"^[0-9a-f]{16}\z"
IDENTICAL, NEAR = 4, 10


def is_hash(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(HASH), F.lit(False))


def hash_bits(text: Column | str) -> Column:
    """The hash as a signed 64-bit number; null if it isn't one. (A direct cast would overflow for a set first bit.)"""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(HASH), F.conv(text, 16, -10).cast("long"))


def hash_text(bits: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(bits) if isinstance(bits, str) else bits)), 16, "0")


def bit_array(bits: Column | str) -> Column:
    """The 64 bits as booleans, the highest first; null of a null."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return F.when(bits.isNotNull(), F.array(*[F.shiftright(bits, 63 - i).bitwiseAND(1) == 1 for i in range(64)]))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1 - distance / 64.0


def classify(distance: Column) -> Column:
    return F.when(distance <= IDENTICAL, "identical").when(distance <= NEAR, "near-duplicate").otherwise("distinct")


def block_hash(block: Column | str) -> Column:
    """The hash of 64 low-frequency coefficients: a bit, first the highest, is set where one exceeds the median of all but the first."""
    block = F.col(block) if isinstance(block, str) else block
    x = F.transform(block, lambda v: v.cast("double"))
    # one row's values and median are computed once, as fields of a single element, not once for each of the 64 bits
    both = F.array(F.struct(x.alias("x"), F.element_at(F.array_sort(F.slice(x, 2, 63)), 32).alias("median")))

    def pack(s: Column) -> Column:
        return F.aggregate(s["x"], F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > s["median"], F.lit(1)).otherwise(F.lit(0)).cast("long")))

    return F.element_at(F.transform(both, pack), 1)
