"""The queries of the eight problems over the tables of TESTDATA.md. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.components import connected_groups
from mosaiq.llm.cooccur import cooccurring_items
from mosaiq.llm.encoding import decoded, encoded
from mosaiq.llm.history import repeated_arrivals
from mosaiq.llm.packing import packed
from mosaiq.llm.setjoin import similar_set_pairs
from mosaiq.llm.skeleton import look_alike_pairs
from mosaiq.llm.survivor import Field, source_rank, survivors, text_length
from mosaiq.llm.tags import tag_sets
from mosaiq.runtime import Scratch, table

CAPACITY = 2048
TRUSTED = ("upload", "link", "seed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pins linked directly or indirectly by matches of at most 10 bits, each with the smallest id of its group."""
    links = table(spark, d, "pin_matches").filter(F.col("distance").between(0, 10))
    return connected_groups(links, "id_a", "id_b").withColumnRenamed("id", "pin_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pins, accepted or arriving, whose tag sets have at least 4 tags each and 0.7 of their union in common."""
    pins = table(spark, d, "pins").select("id", "tags").unionByName(table(spark, d, "incoming_pins").select("id", "tags"))
    return similar_set_pairs(tag_sets(pins, least=4), "0.7")


def _tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurring_items(tag_sets(table(spark, d, "pins")), least=5, share="0.0025", lift="3")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tags that occur together often, and three times as often as chance has it."""
    return _tag_pairs(spark, d).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p3_odds(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p3_found with their counts, lift and continuity-corrected odds ratio."""
    pairs = _tag_pairs(spark, d)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_a", "n_b", "n_ab", "n_sets", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals that repeat an accepted pin or an earlier arrival that doesn't repeat one."""
    return repeated_arrivals(table(spark, d, "pins"), table(spark, d, "incoming_pins"))


def _version_fields() -> dict[str, tuple[Field, str]]:
    """Of each field, how it is chosen; and the column that holds its value."""
    latest = (F.col("created_at"), F.col("version_id"))
    version = F.col("version_id")
    length = text_length(F.col("description"))
    return {
        "source": (Field(version, (source_rank(F.col("source"), TRUSTED), *latest)), "source"),
        "width": (Field(version, latest, F.col("width") > 0), "width"),
        "description": (Field(version, (length, *latest), length > 0), "description"),
    }


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """For each pin the stored version that gives each field of the surviving record."""
    fields = {f"{name}_version": f for name, (f, _) in _version_fields().items()}
    return survivors(table(spark, d, "pin_versions"), "pin_id", fields)


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record itself: the fields' values from the versions of p5_found."""
    fields = {name: Field(F.col(column), f.keys, f.usable) for name, (f, column) in _version_fields().items()}
    return survivors(table(spark, d, "pin_versions"), "pin_id", fields)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document's text by byte_bpe_50k."""
    return encoded(table(spark, d, "documents"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: a digest of the text that the ids of each document stand for."""
    ids = encoded(table(spark, d, "documents"))
    return decoded(ids).select("doc_id", F.md5("text").alias("digest"))


def _packed(spark: SparkSession, d: str, told=None) -> DataFrame:
    placed = packed(encoded(table(spark, d, "documents"), count_only=True), CAPACITY, "doc_id", "n_tokens", told=told)
    return placed.select("container_id", "doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one above 2,048 tokens, with its container of 2,048 tokens."""
    return _packed(spark, d)


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, the bound that no plan goes below and what proves the plan (see Packing), and the share of unused space."""
    told = []
    all_ = _packed(spark, d, told.append).agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * CAPACITY
    return all_.select("containers", "tokens", F.lit(told[0].bound).alias("bound"), F.lit(told[0].proof).alias("proof"), F.round(F.when(room > 0, 1 - F.col("tokens") / room).otherwise(0.0), 6).alias("unused"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any packing: documents placed, containers above the capacity, gaps in their numbers, pieces that needn't or don't fit together."""
    rows = Scratch(spark, "checks").save(_packed(spark, d), "placed")
    held = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    whole = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"), F.sum(F.when(F.col("start_token") == F.col("piece") * CAPACITY, 0).otherwise(1)).alias("shifted"))
    counts = held.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count(F.lit(1))).alias("gaps"))
    cut = F.count_if((F.col("pieces") != F.ceil(F.col("n") / CAPACITY)) | (F.col("last") != F.col("pieces") - 1) | (F.col("shifted") > 0))
    return whole.agg(F.count(F.lit(1)).alias("documents"), cut.alias("badly_cut")).join(F.broadcast(counts))  # one row


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose different texts look the same."""
    return look_alike_pairs(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_odds, p4_found, p5_found, p5_survivors, p6_ids, p6_texts, p7_containers, p7_summary, p7_checks, p8_found)}
