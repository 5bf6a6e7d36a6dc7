"""Recommendations for one pin: by content, by who saved it, and a blend of these with popularity and recency.

A ranker is a function of (pins, saves, subject_id, now) that gives (id, score, reason) for every other pin. Rankers are
looked up by name in RANKERS; any function of that shape can be registered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.dates import epoch_ms, recency
from mosaiq.functions.text import document_text, tokens
from mosaiq.runtime import Scratch

# The weights, and the sentences of reasons below.
WEIGHTS = {"content": 0.45, "collaborative": 0.35, "popularity": 0.10, "recency": 0.10}
HALF_POINT = 5


def subject_cosine(documents: DataFrame, subject_id) -> DataFrame:
    """(id, score, top_term): the cosine of each document's tf-idf vector to the subject's, for documents sharing a term.

    documents: (id, words), words an array of tokens, each id once, the subject among them. idf is ln((N + 1) / (df + 1)) + 1 over
    all documents; tf is divided by the document's length. top_term has the largest contribution; of equals the one that
    comes first in the shorter vector (the subject's if both are as long), counted by first occurrence.

    The documents are read once for (id, term, tf, place); df comes from that, and is joined back on term. Only the
    norms need all terms of a document; the dot products need those that the subject has.
    """
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    words = documents.select("id", F.size("words").alias("len"), F.posexplode("words").alias("at", "term"))
    tf = words.groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("at"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))  # n is one row
    idf = df.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = tf.join(idf, "term").select("id", "term", "at", (F.col("k") / F.col("len") * F.col("idf")).alias("w"))
    subject = weights.filter(F.col("id") == subject_id).select("term", F.col("w").alias("sw"), F.col("at").alias("s_at"))
    size = subject.agg(F.count(F.lit(1)).alias("s_terms"), F.sqrt(F.sum(F.col("sw") * F.col("sw"))).alias("s_norm"))
    joined = weights.filter(F.col("id") != subject_id).join(subject, "term", "left")
    given = F.col("sw").isNotNull()
    part = F.col("w") * F.col("sw")
    best = lambda place: F.max(F.when(given, F.struct(F.round(part, 12).alias("p"), (-F.col(place)).alias("o"), F.col("term").alias("t"))))
    rows = joined.groupBy("id").agg(F.sum(part).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count(F.lit(1)).alias("terms"), best("at").alias("own"), best("s_at").alias("theirs"))
    rows = rows.filter(F.col("dot") > 0).join(F.broadcast(size))  # one row
    return rows.select("id", (F.col("dot") / (F.col("norm") * F.col("s_norm"))).alias("score"), F.when(F.col("s_terms") <= F.col("terms"), F.col("theirs.t")).otherwise(F.col("own.t")).alias("top_term"))


def _others(pins: DataFrame, subject_id) -> DataFrame:
    return pins.filter(F.col("id") != subject_id).select("id")


def content_based(pins: DataFrame, saves: DataFrame, subject_id, now: int = 0) -> DataFrame:
    """Cosine of title and description."""
    scored = subject_cosine(pins.select("id", tokens(document_text()).alias("words")), subject_id)
    rows = _others(pins, subject_id).join(scored, "id", "left")
    reason = F.when(F.col("top_term").isNotNull(), F.concat(F.lit("Both about “"), F.col("top_term"), F.lit("”"))).otherwise("Loosely related")
    return rows.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason"))


def saver_overlap(saves: DataFrame, subject_id) -> DataFrame:
    """(id, shared, score): the Jaccard similarity of each pin's savers to the subject's, for pins sharing one.

    The subject's savers are joined to their other saves; a pin's own number of savers comes from one count over all.
    """
    pairs = saves.filter(F.col("user_id").isNotNull() & F.col("pin_id").isNotNull()).select("user_id", F.col("pin_id").alias("id")).distinct()
    mine = pairs.filter(F.col("id") == subject_id).select("user_id")
    total = mine.agg(F.count(F.lit(1)).alias("mine"))
    savers = mine.withColumn("also", F.lit(1))
    counted = pairs.filter(F.col("id") != subject_id).join(savers, "user_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("also").alias("shared"))
    rows = counted.filter("shared > 0").join(F.broadcast(total))  # one row
    return rows.select("id", "shared", (F.col("shared") / (F.col("n") + F.col("mine") - F.col("shared"))).alias("score"))


def collaborative(pins: DataFrame, saves: DataFrame, subject_id, now: int = 0) -> DataFrame:
    """Jaccard similarity of savers."""
    rows = _others(pins, subject_id).join(saver_overlap(saves, subject_id), "id", "left")
    people = F.when(F.col("shared") == 1, " person").otherwise(" people")
    reason = F.when(F.col("shared") > 0, F.concat(F.col("shared").cast("string"), people, F.lit(" saved both"))).otherwise("No shared saves yet")
    return rows.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason"))


def make_hybrid(weights: dict[str, float] | None = None) -> Callable[..., DataFrame]:
    weights = weights or WEIGHTS

    def hybrid(pins: DataFrame, saves: DataFrame, subject_id, now: int = 0) -> DataFrame:
        """A weighted sum of four parts, each divided by its largest value; the reason is that of the largest part.

        Popularity is s / (s + 5) of a pin's saves. Where no candidate shares a saver with the subject, the collaborative weight goes to
        content. The largest values are one row, added to all by a broadcast, not by a window over all rows.
        """
        content = content_based(pins, saves, subject_id).select("id", F.col("score").alias("c"), F.col("reason").alias("c_reason"))
        shared = collaborative(pins, saves, subject_id).select("id", F.col("score").alias("k"), F.col("reason").alias("k_reason"))
        counts = saves.filter("user_id is not null").select("user_id", F.col("pin_id").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("s"))
        rows = pins.filter(F.col("id") != subject_id).select("id", recency(epoch_ms("created_at"), now).alias("r"))
        rows = rows.join(content, "id").join(shared, "id").join(counts, "id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
        rows = rows.withColumn("p", F.col("s") / (F.col("s") + HALF_POINT))
        rows = Scratch(pins.sparkSession, "hybrid").save(rows, "parts")  # read twice
        rows = rows.join(F.broadcast(rows.agg(*[F.max(x).alias(f"m{x}") for x in "ckpr"])))  # one row
        share = lambda x: F.when(F.col(f"m{x}") > 0, F.col(x) / F.col(f"m{x}")).otherwise(0.0)
        signal = F.col("mk") > 0
        parts = {
            "content": F.when(signal, weights["content"]).otherwise(weights["content"] + weights["collaborative"]) * share("c"),
            "collaborative": F.when(signal, weights["collaborative"]).otherwise(0.0) * share("k"),
            "popularity": weights["popularity"] * share("p"),
            "recency": weights["recency"] * share("r"),
        }
        rows = rows.select("*", *[v.alias(k) for k, v in parts.items()])
        score: Column = sum((F.col(k) for k in list(parts)[1:]), F.col("content"))
        top = F.greatest(*parts)
        why = F.when(score == 0, "No signal yet").when(F.col("content") == top, F.col("c_reason")).when(F.col("collaborative") == top, F.col("k_reason")).when(F.col("popularity") == top, "Popular right now").otherwise("Freshly added")
        return rows.select("id", score.alias("score"), why.alias("reason"))

    return hybrid


RANKERS: dict[str, Callable[..., DataFrame]] = {"content": content_based, "collaborative": collaborative, "hybrid": make_hybrid()}


def ranker(name: str | None = None, configured: str | None = None) -> Callable[..., DataFrame]:
    """By name, else by the configured one (related reads the session's mosaiq.recommender), else hybrid; unknown names are passed over."""
    return next(RANKERS[n] for n in (name, configured, "hybrid") if n in RANKERS)


def related(pins: DataFrame, saves: DataFrame, subject_id, *, strategy: str | None = None, limit: int = 12, min_score: float = 0.0, now: int = 0) -> DataFrame:
    """The best other pins with a score above min_score: by score, then newest, then id falling."""
    scored = ranker(strategy, pins.sparkSession.conf.get("mosaiq.recommender", None))(pins, saves, subject_id, now).filter(F.col("score") > min_score)
    return scored.join(pins.select("id", "created_at"), "id").orderBy(F.desc(F.round("score", 9)), F.desc("created_at"), F.desc("id")).limit(limit).drop("created_at")


def shape_similarity(w: Column, h: Column, sw: Column, sh: Column) -> Column:
    """1 for equal proportions, less by the logarithm of their ratio, 0 if a dimension is missing."""
    full = (w > 0) & (h > 0) & (sw > 0) & (sh > 0)
    ratio = F.log((w / F.nullif(h, F.lit(0))) / (sw / F.nullif(sh, F.lit(0))))
    return F.when(full, F.greatest(F.lit(0.0), 1 - F.abs(ratio))).otherwise(0.0)


def rank_similar(pool: DataFrame, subject_id, *, shape: float = 0.15, author: float = 0.10) -> DataFrame:
    """(id, author, score, reason) of the other images: cosine of tags, raised by like proportions and the same author.

    pool: (id, author, tags, width, height), each id once, the subject among them.
    """
    scored = subject_cosine(pool.select("id", tokens(F.concat_ws(" ", "tags")).alias("words")), subject_id)
    subject = pool.filter(F.col("id") == subject_id).select(F.col("author").alias("sa"), F.col("width").alias("sw"), F.col("height").alias("sh")).limit(1)
    rows = pool.filter(F.col("id") != subject_id).select("id", "author", "width", "height").join(scored, "id", "left").join(F.broadcast(subject))  # one row
    same = F.coalesce(F.col("author") == F.col("sa"), F.lit(False))
    bonus = 1 + shape * shape_similarity(F.col("width"), F.col("height"), F.col("sw"), F.col("sh")) + author * F.when(same, 1).otherwise(0)
    tagged = F.when(F.col("top_term").isNotNull(), F.concat(F.lit("Both tagged “"), F.col("top_term"), F.lit("”"))).otherwise("Loosely related")
    reason = F.when(same, F.concat(F.lit("More from "), F.col("author"))).otherwise(tagged)
    return rows.select("id", "author", (F.coalesce("score", F.lit(0.0)) * bonus).alias("score"), reason.alias("reason"))


def similar_images(pages: DataFrame, subject: DataFrame, *, limit: int = 24, min_score: float = 0.02, per_author: int = 3) -> DataFrame:
    """The best of several result pages: pooled, ranked, at most per_author of one author, at most limit.

    pages: (page, place, id, author, tags, width, height); an image in several pages is taken from the first place it has.
    subject: one row of the same columns without page and place; it is taken out of the pages. An author's row number in
    the order of the ranking gives the same rows as walking down it with a count for each author.
    """
    key = subject.first()["id"]
    columns = ["id", "author", "tags", "width", "height"]
    first = F.min_by(F.struct(*columns[1:]), F.struct("page", "place"))
    pool = pages.filter(F.col("id") != key).groupBy("id").agg(first.alias("row"), F.min(F.struct("page", "place")).alias("first")).select("id", "row.*", "first")
    scored = rank_similar(pool.select(*columns).unionByName(subject.select(*columns)), key).filter(F.col("score") > min_score)
    scored = scored.join(pool.select("id", "first"), "id")
    order = [F.desc(F.round("score", 9)), F.asc("first")]
    kept = scored.withColumn("nth", F.row_number().over(Window.partitionBy("author").orderBy(*order))).filter(F.col("nth") <= per_author)
    return kept.orderBy(*order).limit(limit).select("id", "author", "score", "reason")


def tag_overlap(pins: DataFrame, subject_id) -> DataFrame:
    """(id, score): Jaccard similarity of tags, each weighted by its idf over all pins, for pins sharing a tag with the subject."""
    n = pins.agg(F.count(F.lit(1)).alias("n"))
    tags = pins.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    df = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))  # one row
    weighted = tags.join(df.select("tag", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w")), "tag")
    mine = weighted.filter(F.col("id") == subject_id).select("tag", F.lit(1).alias("also"))
    total = weighted.filter(F.col("id") == subject_id).agg(F.sum("w").alias("mine"))
    rows = weighted.filter(F.col("id") != subject_id).join(mine, "tag", "left").groupBy("id").agg(F.sum("w").alias("own"), F.sum(F.when(F.col("also") == 1, F.col("w"))).alias("both"))
    return rows.filter("both > 0").join(F.broadcast(total)).select("id", (F.col("both") / (F.col("own") + F.col("mine") - F.col("both"))).alias("score"))
