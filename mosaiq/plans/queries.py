"""Every operator as a query over the driver's tables; each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import color as C
from mosaiq.functions import hashing as H
from mosaiq.functions import text as T
from mosaiq.functions.dates import epoch_ms, recency, time_ago
from mosaiq.operators import colors, dashboard, duplicates, evaluate, feed, images, paging, popularity, recommend, store, topics
from mosaiq.operators.filters import form_errors, matches, parse_visibility, text_score, validate, visible_to
from mosaiq.plans import fixtures as X
from mosaiq.plans.oracle import SQL as SQL  # noqa: PLC0414
from mosaiq.runtime import Scratch, table
from mosaiq.sources import seed, sinks, tables
from mosaiq.sources.external import image_by_id, normalise
from mosaiq.streaming import comments as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: A place in the feed: noon of 2024-03-01.
CURSOR = paging.encode_cursor(1_709_294_400_000, "m")
TEAL = (20, 160, 150)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ms(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", epoch_ms("created_at").alias("created_ms"), *more)


def _seen(spark: SparkSession, d: str, *columns: str, viewer: str | None = None) -> DataFrame:
    """The pins that the viewer may see."""
    return tables.pins(spark, d, *columns, "author_id", "visibility").filter(visible_to(viewer))


def _subject(spark: SparkSession, d: str) -> str:
    """Of the pins the viewer may see the one most users saved; of equals the first by id."""
    seen = _seen(spark, d, viewer=X.AUTHOR).select(F.col("id").alias("pin_id"))
    row = tables.saves(spark, d).join(seen, "pin_id", "left_semi").groupBy("pin_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pin_id").first()
    return row["pin_id"] if row else ""


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# near duplicates


@query
def near_duplicate_pairs(spark, d):
    """The flagship: vectors hashed to 64 bits, all pairs within 18 of them."""
    return duplicates.duplicate_pairs(X.vector_hashes(spark, d), 18)


@query
def pin_duplicate_pairs(spark, d):
    return duplicates.duplicate_pairs(duplicates.hashed(_seen(spark, d, "phash", viewer=X.AUTHOR)), 10)


@query
def near_duplicates_of(spark, d):
    """What is near the most frequent hash."""
    p = _seen(spark, d, "phash", viewer=X.AUTHOR)
    probe = p.filter(H.is_hash("phash")).groupBy("phash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "phash").first()
    return duplicates.near_duplicates_of(p, probe["phash"] if probe else "0" * 16, threshold=20, limit=50).select("id", "distance", "verdict")


@query
def duplicate_guard(spark, d):
    p = tables.pins(spark, d, "phash", "author_id", "visibility")
    first = p.filter(visible_to(X.AUTHOR) & H.is_hash("phash")).orderBy("id").first()
    return duplicates.duplicate_guard(p, first["phash"] if first else "0" * 16, X.AUTHOR).select("distance", "verdict")


@query
def duplicate_clusters(spark, d):
    return duplicates.duplicate_groups(X.vector_hashes(spark, d), 18)


@query
def pin_duplicate_groups(spark, d):
    return duplicates.duplicate_groups(duplicates.hashed(_seen(spark, d, "phash", viewer=X.AUTHOR)), 10)


@query
def cluster_width(spark, d):
    return duplicates.duplicate_groups(X.vector_hashes(spark, d), 18).select("group_id", "size", "max_distance").distinct()


# feeds and pages


@query
def feed_page(spark, d):
    return _ms(paging.list_pins(tables.pins(spark, d, "created_at", "author_id", "visibility")).rows)


@query
def feed_page_after_cursor(spark, d):
    return _ms(paging.list_pins(tables.pins(spark, d, "created_at", "author_id", "visibility"), limit=50, cursor=CURSOR, viewer=X.AUTHOR).rows, "author_id")


@query
def author_board(spark, d):
    return _ms(paging.list_all_pins(tables.pins(spark, d, "created_at", "author_id", "visibility"), viewer=X.AUTHOR, author=X.AUTHOR))


@query
def board_oldest_first(spark, d):
    return store.board(tables.pins(spark, d, "created_at", "author_id", "visibility", "title"), X.AUTHOR, "oldest").select("id", "title")


@query
def board_by_title(spark, d):
    return store.board(tables.pins(spark, d, "created_at", "author_id", "visibility", "title"), X.AUTHOR, "title").select("id", "title")


@query
def feed_union(spark, d):
    stored = tables.pins(spark, d, "created_at", "author_id", "visibility").filter(visible_to())
    return feed.feed_items(stored, X.external(spark, d)).orderBy("phase", "at").select("phase", "key", "kind", "id")


@query
def feed_pages(spark, d):
    """Pages of the feed by their cursors: the first two of stored pins, two of external results; with the next cursor."""
    stored, found = tables.pins(spark, d, "created_at", "author_id", "visibility"), X.external(spark, d)
    at, out = None, None
    for number, start in enumerate((None, None, paging.encode_feed_cursor(("external", 3, 1)), paging.encode_feed_cursor(("external", 11, 5)))):
        rows, at = feed.feed_page(stored, found, at if number == 1 else start, topics=12)
        rows = rows.select(F.lit(number).alias("page"), "key", "kind", F.lit(at).cast("string").alias("next"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def cursor_codec(spark, d):
    """The cursor behind each pin, and what it is read as; and what a title is read as."""
    rows = paging.read_cursors(paging.cursors(tables.pins(spark, d, "created_at", "title")))
    return paging.read_cursors(rows.withColumnsRenamed({"cursor_ms": "ms", "cursor_id": "row_id"}), "title").select("id", "cursor", "ms", "row_id", (F.col("cursor_ms").isNull() & F.col("cursor_id").isNull()).alias("title_is_none"))


@query
def feed_cursors(spark, d):
    """What cursors of the feed are read as."""
    texts = ("d.abc", "d.", "p.3.2", "p.0.1", "p.3.0", "p.x.1", "q.1.1", "", "p.11.16")
    rows = [(t, str(x[0]), None if x[1] is None else str(x[1]), x[2] if len(x) > 2 else None) for t in texts for x in [paging.decode_feed_cursor(t)]]
    return spark.createDataFrame(rows, "cursor string, phase string, at string, page int")


@query
def orders_keyset_page(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit("public").alias("visibility"), F.col("o_custkey").cast("string").alias("author_id"))
    return _ms(paging.list_pins(rows, limit=100, cursor=paging.encode_cursor(820_454_400_000, 500), id_type=int).rows)


@query
def visible_pins(spark, d):
    return tables.pins(spark, d, "author_id", "visibility").filter(visible_to(X.AUTHOR)).select("id")


@query
def pins_by_ids(spark, d):
    wanted = tables.saves(spark, d).filter(F.col("user_id") == X.AUTHOR).select(F.col("pin_id").alias("id"))
    wanted = wanted.unionByName(spark.createDataFrame([("no-such-pin",)], "id string"))
    return _ms(store.pins_by_ids(tables.pins(spark, d, "created_at", "author_id", "visibility"), wanted))


@query
def pin_view(spark, d):
    return store.pin_view(tables.pins(spark, d, "title", "created_at", "analyzed_at", "source", "public_id", "visibility")).select("id", "title", "created_at", "analyzed_at", "source", "visibility")


@query
def unanalysed_batch(spark, d):
    return _ms(store.unanalysed(tables.pins(spark, d, "created_at", "analyzed_at")))


@query
def pin_list(spark, d):
    """The fields that a list of pins shows."""
    rows = store.list_view(table(spark, d, "pins").filter(visible_to()).distinct())
    return rows.withColumn("tags", F.concat_ws("|", "tags")).withColumn("created_at", epoch_ms("created_at")).withColumn("analyzed_at", epoch_ms("analyzed_at")).withColumn("palette", F.col("palette").isNull()).withColumn("color_families", F.col("color_families").isNull())


@query
def pin_hash_list(spark, d):
    return store.pin_hashes(tables.pins(spark, d, "phash", "title", "image_url", "author_id", "visibility"))


@query
def analysis_coverage(spark, d):
    return _round(store.analysis_coverage(tables.pins(spark, d, "phash", "author_id", "visibility"), X.AUTHOR), "coverage")


@query
def pin_counts(spark, d):
    p = tables.pins(spark, d, "author_id", "visibility")
    return store.count_pins(p).withColumn("scope", F.lit("public")).unionByName(store.count_pins(p, X.AUTHOR).withColumn("scope", F.lit("author")))


@query
def private_count(spark, d):
    return store.private_count(tables.pins(spark, d, "created_at", "author_id", "visibility"), X.AUTHOR)


@query
def saved_flags(spark, d):
    return tables.saved_flags(tables.pins(spark, d).select("id"), tables.saves(spark, d), X.AUTHOR)


# search


@query
def tags_overlap(spark, d):
    return store.find_by_tags(tables.pins(spark, d, "tags", "created_at", "author_id", "visibility"), ["photo", "nature", "lake", "ocean"], limit=50).select("id", "overlap")


@query
def text_search(spark, d):
    return store.search_pins(tables.pins(spark, d, "title", "description", "created_at", "author_id", "visibility"), "Lighthouses near the harbour", limit=60).select("id", "score")


@query
def discover_search(spark, d):
    return _seen(spark, d, "title", "description").filter(matches("light walks")).select("id")


@query
def discover_search_plain(spark, d):
    return _seen(spark, d, "title", "description").filter(matches("At ")).select("id")


# popularity


def _engaged(spark, d, viewer=None):
    return _seen(spark, d, "created_at", viewer=viewer), tables.saves(spark, d), tables.comments(spark, d, "pin_id")


def _popular(spark, d, window):
    rows = popularity.rank_by_popularity(*_engaged(spark, d), window=window, now=X.NOW, limit=500)
    return rows.select("rank", "id", "saves", "comments", "score")


@query
def popular_week(spark, d):
    return _popular(spark, d, "week")


@query
def popular_month(spark, d):
    return _popular(spark, d, "month")


@query
def popular_all(spark, d):
    return _popular(spark, d, "all")


@query
def leaderboard_totals(spark, d):
    return popularity.leaderboard_totals(*_engaged(spark, d), window="month", now=X.NOW)


@query
def top_pins(spark, d):
    p, s, c = _engaged(spark, d, X.AUTHOR)
    return popularity.top_pins(p.filter(F.col("author_id") == X.AUTHOR), s, c).select("id", "saves", "comments", "score")


@query
def save_counts(spark, d):
    return tables.save_counts(tables.saves(spark, d))


@query
def comment_counts(spark, d):
    return tables.comment_counts(tables.comments(spark, d, "pin_id"))


@query
def comment_counts_by_author(spark, d):
    return tables.comment_counts(tables.comments(spark, d, "author_id"), "author_id")


@query
def comment_thread(spark, d):
    c = tables.comments(spark, d, "pin_id", "body", "author", "author_id", "created_at")
    return tables.thread(c, table(spark, d, "users"), _subject(spark, d)).select("id", "body", "author", "author_id")


# recommendations


@query
def content_related(spark, d):
    p = _seen(spark, d, "title", "description", "created_at", viewer=X.AUTHOR)
    return _round(recommend.related(p, tables.saves(spark, d), _subject(spark, d), strategy="content"), "score").select("id", "score")


@query
def collaborative_related(spark, d):
    p = _seen(spark, d, "title", "description", "created_at", viewer=X.AUTHOR)
    return _round(recommend.related(p, tables.saves(spark, d), _subject(spark, d), strategy="collaborative", limit=30), "score")


@query
def hybrid_related(spark, d):
    p = _seen(spark, d, "title", "description", "created_at", viewer=X.AUTHOR)
    return _round(recommend.related(p, tables.saves(spark, d), _subject(spark, d), now=X.NOW), "score").select("id", "score")


@query
def content_reasons(spark, d):
    p = _seen(spark, d, "title", "description", viewer=X.AUTHOR)
    return _round(recommend.content_based(p, tables.saves(spark, d), _subject(spark, d)), "score")


@query
def similar_items_capped(spark, d):
    rows = X.tagged(spark, d)
    pages = rows.filter("id <> 1").select((F.col("id") % 3).alias("page"), F.col("id").alias("place"), "*")
    return _round(recommend.similar_images(pages.unionByName(pages.withColumn("page", F.lit(3).cast("bigint"))), rows.filter("id = 1")), "score").drop("reason")


@query
def tag_overlap_related(spark, d):
    return _round(recommend.tag_overlap(X.tagged(spark, d), 1), "score").orderBy(F.desc("score"), "id").limit(100)


@query
def tag_overlap_all(spark, d):
    """All rows of which tag_overlap_related gives the first 100."""
    return _round(recommend.tag_overlap(X.tagged(spark, d), 1), "score")


# terms


@query
def discover_topics(spark, d):
    return _round(topics.topics(_seen(spark, d, "title", "description")), "weight")


@query
def board_keywords(spark, d):
    return topics.keywords(tables.pins(spark, d, "title", "description", "author_id").filter(F.col("author_id") == X.AUTHOR))


@query
def document_frequencies(spark, d):
    return topics.document_frequencies(_seen(spark, d, "title", "description"))


# colour


@query
def color_rank(spark, d):
    return _round(colors.rank_by_color(X.swatches(spark, d), TEAL, limit=60), "score", "closest_share", "closest_delta")


@query
def color_rank_prefiltered(spark, d):
    near = colors.with_families(X.swatches(spark, d), C.families_near(*TEAL))
    return _round(colors.rank_by_color(near, TEAL, limit=60), "score", "closest_share", "closest_delta")


@query
def color_family_slices(spark, d):
    return _round(colors.family_slices(X.swatches(spark, d)), "weight")


@query
def palette_lab(spark, d):
    c = C.rgb("r", "g", "b")
    lab, hsv = C.to_lab(c), C.to_hsv(c)
    rounded = [F.round(x, 6).alias(n) for n, x in (("l", lab.l), ("a", lab.a), ("b_star", lab.b), ("hue", hsv.h), ("saturation", hsv.s), ("value", hsv.v), ("luminance", C.luminance(c)))]
    return X.swatches(spark, d).select("id", "pos", C.to_hex(c).alias("hex"), *rounded, C.readable_on(c).alias("on"), C.family(c).alias("family"))


@query
def palette_drift(spark, d):
    a = X.swatches(spark, d)
    b = a.withColumn("r", F.least(F.lit(255), F.col("r") + 7))
    return _round(colors.palette_drift(a, b), "drift")


@query
def pins_with_palette(spark, d):
    """Pins that have a palette of given families; a pin's palette here is one swatch, told by the length of its id."""
    p = tables.pins(spark, d, "created_at", "author_id", "visibility")
    kind = F.length("id") % 3
    one = lambda r, g, b: F.array(F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit("").alias("hex"), F.lit(1.0).alias("share")))
    p = p.withColumn("palette", F.when(kind == 0, one(224, 36, 36)).when(kind == 1, one(37, 99, 235)))
    p = p.withColumn("color_families", F.transform("palette", lambda s: C.family(C.Rgb(s["r"], s["g"], s["b"]))))
    return _ms(store.pins_with_palette(p, families=C.families_near(220, 40, 40), viewer=X.AUTHOR, limit=100))


# dashboard


@query
def activity_14d(spark, d):
    return dashboard.activity(tables.pins(spark, d, "created_at"), "2024-12-31").select(F.col("day").cast("string").alias("day"), "pins")


@query
def board_counts(spark, d):
    return dashboard.board_counts(tables.pins(spark, d, "author_id"), tables.saves(spark, d), tables.comments(spark, d, "pin_id"), X.AUTHOR)


@query
def duplicate_counts(spark, d):
    return dashboard.duplicate_counts(duplicates.duplicate_groups(duplicates.hashed(_seen(spark, d, "phash", viewer=X.AUTHOR)), 10, width=False))


@query
def dashboard_stats(spark, d):
    """All numbers of one user's board as (part, name, value)."""
    p = tables.pins(spark, d, "created_at", "author_id", "visibility", "phash")
    parts = dashboard.dashboard_stats(p, tables.saves(spark, d), tables.comments(spark, d, "pin_id"), X.pin_swatches(p), X.AUTHOR, "2024-12-31")
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias("value")
    rows = [parts[k].select(F.lit(k).alias("part"), F.lit(c).alias("name"), number(c)) for k in ("counts", "analysis", "duplicates") for c in parts[k].columns]
    named = {"activity": ("day", "pins"), "palette": ("family", "weight"), "top": ("id", "score"), "pins": ("id", "score")}
    rows += [parts[k].select(F.lit(k).alias("part"), F.col(a).cast("string").alias("name"), number(b)) for k, (a, b) in named.items()]
    return reduce(DataFrame.unionByName, rows)


# evaluation


def _distances(spark, d):
    """Hashes of vectors against those of the originals, every vector with an id divisible by 50; positive where labels agree."""
    h = X.vector_hashes(spark, d)
    return evaluate.labelled_distances(h, h.filter("id % 50 = 0"), "label")


@query
def threshold_sweep(spark, d):
    return _round(evaluate.threshold_sweep(_distances(spark, d), 64), "precision", "recall", "f1")


@query
def best_threshold(spark, d):
    return _round(evaluate.best_threshold(evaluate.threshold_sweep(_distances(spark, d), 64)), "f1").select("threshold", "f1")


@query
def last_perfect_precision(spark, d):
    return evaluate.last_perfect_precision(evaluate.threshold_sweep(_distances(spark, d), 64))


@query
def edit_stats(spark, d):
    return evaluate.group_stats(_distances(spark, d).filter("positive"), "label", caught=18)


@query
def distance_percentiles(spark, d):
    rows = [evaluate.percentile(_distances(spark, d), "distance", p, ["positive"]).withColumn("p", F.lit(p)) for p in (0.05, 0.5, 0.95)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# changes


def _arriving(spark, d):
    return table(spark, d, "incoming_pins").select("id", "title", "author_id", "provider", "provider_id")


@query
def insert_if_absent(spark, d):
    stored = tables.pins(spark, d, "title", "author_id", "provider", "provider_id").filter("provider_id is not null")
    return store.insert_absent(stored, _arriving(spark, d).filter("provider_id is not null"), ["author_id", "provider", "provider_id"]).select("author_id", "provider", "provider_id")


@query
def upsert_by_id(spark, d):
    stored = tables.pins(spark, d, "title")
    changed = stored.filter(F.length("id") % 3 == 0).withColumn("title", F.upper("title"))
    return store.upsert(stored, changed.unionByName(spark.createDataFrame([("new-pin", "New")], "id string, title string")), force=True)


@query
def set_analysis(spark, d):
    p = tables.pins(spark, d, "phash", "analyzed_at").withColumn("palette", F.lit(None).cast(f"{images.SWATCH}")).withColumn("color_families", F.lit(None).cast("array<string>"))
    red = F.array(F.struct(F.lit(224).alias("r"), F.lit(36).alias("g"), F.lit(36).alias("b"), F.lit("#e02424").alias("hex"), F.lit(1.0).alias("share")))
    results = p.filter("analyzed_at is null").select("id", F.lit("00ff00ff00ff00ff").alias("phash"), red.alias("palette"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("analyzed_at"))
    return store.set_analysis(p, results).select("id", "phash", F.concat_ws(",", "color_families").alias("families"), epoch_ms("analyzed_at").alias("analyzed_ms"))


@query
def set_visibility(spark, d):
    p = tables.pins(spark, d, "author_id", "visibility")
    one = p.filter(F.col("author_id") == X.AUTHOR).agg(F.min("id")).first()[0]
    return store.set_visibility(p, one, X.AUTHOR, "private").select("id", "visibility")


@query
def backfill_visibility(spark, d):
    return store.backfill_visibility(tables.pins(spark, d, "visibility")).groupBy("visibility").agg(F.count(F.lit(1)).alias("pins"))


def _deleted(spark, d):
    p = tables.pins(spark, d, "author_id", "source", "public_id")
    gone = p.filter(F.col("author_id") == X.AUTHOR).select("id", "author_id").unionByName(p.filter(F.col("author_id") != X.AUTHOR).select("id", F.lit(X.AUTHOR).alias("author_id")))
    return store.delete_pins(p, tables.saves(spark, d), tables.comments(spark, d, "pin_id"), gone)


@query
def cascade_delete(spark, d):
    parts = _deleted(spark, d)
    rows = [parts[k].agg(F.count(F.lit(1)).alias("left")).withColumn("part", F.lit(k)) for k in ("pins", "saves", "comments", "assets")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def toggle_saves(spark, d):
    s = tables.saves(spark, d)
    flips = s.filter(F.length("pin_id") % 2 == 0).unionByName(s.select("user_id", F.concat("pin_id", F.lit("-x")).alias("pin_id")))
    return store.toggle_saves(s, flips)


@query
def create_pins(spark, d):
    """Arriving pins made anew: those created, and those whose image their author has saved."""
    columns = ("title", "author_id", "provider", "provider_id", "public_id", "source", "visibility", "tags")
    new = table(spark, d, "incoming_pins").select("id", *columns).distinct()
    made = store.create_pins(tables.pins(spark, d, "author_id", "provider", "provider_id"), new, now=X.NOW, suffix=F.substring(F.md5("id"), 1, 6))
    created = made["created"].select("id", "author_id", "provider_id", "source", "visibility", F.size("tags").alias("n_tags"), epoch_ms("created_at").alias("created_ms"))
    saved = made["already_saved"].select(F.lit(None).cast("string"), "author_id", "provider_id", "source", "visibility", F.lit(None).cast("int"), F.lit(None).cast("bigint"))
    return created.union(saved)


@query
def store_analysis(spark, d):
    """An analysis within the request: a pin of which nothing was found isn't stamped."""
    p = tables.pins(spark, d, "phash", "analyzed_at").withColumn("palette", F.lit(None).cast(images.SWATCH)).withColumn("color_families", F.lit(None).cast("array<string>"))
    found = p.filter("analyzed_at is null").select("id", F.lit("00ff00ff00ff00ff").alias("phash"), F.lit(None).cast(images.SWATCH).alias("palette"), (F.length("id") % 2 == 0).alias("analyzed"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("analyzed_at"))
    return store.store_analysis(p, found).select("id", "phash", epoch_ms("analyzed_at").alias("analyzed_ms"))


@query
def forgotten_comments(spark, d):
    """How many comments go with each pin of one author."""
    gone = tables.pins(spark, d, "author_id").filter(F.col("author_id") == X.AUTHOR).select("id")
    return store.forget_pins(tables.comments(spark, d, "pin_id"), gone)["removed"]


@query
def form_limits(spark, d):
    """Pins and comments that a form refuses, with the fields at fault."""
    p = form_errors(tables.pins(spark, d, "title", "description")).select(F.lit("pin").alias("kind"), "id", F.concat_ws(",", "errors").alias("errors"))
    c = form_errors(tables.comments(spark, d, "body")).select(F.lit("comment"), F.col("id").cast("string"), F.concat_ws(",", "errors"))
    return p.union(c).filter("errors <> ''")


@query
def parsed_visibility(spark, d):
    return tables.pins(spark, d, "visibility").select("id", parse_visibility(F.upper("visibility")).alias("upper"), parse_visibility("visibility").alias("as_stored"))


@query
def validate_pins(spark, d):
    p = tables.pins(spark, d, "title", "description", "image_url", "thumb_url", "author_id", "created_at", "phash", "source", "visibility", "provider")
    return validate(p).select("id", F.concat_ws(",", "broken").alias("broken"))


# functions


@query
def text_functions(spark, d):
    p = tables.pins(spark, d, "title", "description")
    doc = T.document_text()
    return p.select("id", F.concat_ws(" ", T.tokens(doc)).alias("tokens"), T.pin_slug("title", F.lit("abc123")).alias("slug"), T.file_slug("description").alias("file"), T.byte_size(F.length(doc) * 9973).alias("bytes"), text_score("light near").alias("score"))


@query
def search_queries(spark, d):
    return X.tagged(spark, d).select("id", F.concat_ws("|", T.search_queries(F.col("tags"))).alias("queries"))


@query
def date_functions(spark, d):
    ms = epoch_ms("created_at")
    return tables.pins(spark, d, "created_at").select("id", ms.alias("created_ms"), time_ago(ms, X.NOW).alias("ago"), F.round(recency(ms, X.NOW), 6).alias("recency"))


@query
def hash_functions(spark, d):
    p = tables.pins(spark, d, "phash").filter("phash is not null")
    distance = H.hamming(H.hash_bits("phash"), F.lit(0x0F0F0F0F0F0F0F0F).cast("long"))
    return p.select("id", H.is_hash("phash").alias("valid"), H.hash_text(H.hash_bits("phash")).alias("again"), distance.alias("distance"), F.round(H.similarity(distance), 6).alias("similarity"), H.classify(distance).alias("verdict"))


@query
def hex_colors(spark, d):
    """The first digits of each hash read as a colour of six and of three digits, and its title as none."""
    p = tables.pins(spark, d, "phash", "title").filter(H.is_hash("phash"))
    full, short, bad = C.from_hex(F.concat(F.lit(" #"), F.upper(F.substring("phash", 1, 6)))), C.from_hex(F.substring("phash", 1, 3)), C.from_hex("title")
    return p.select("id", full.r.alias("r"), full.g.alias("g"), full.b.alias("b"), short.r.alias("short_r"), short.b.alias("short_b"), bad.r.isNull().alias("title_is_none"))


@query
def hash_bits(spark, d):
    p = tables.pins(spark, d, "phash").filter("phash is not null")
    return p.select("id", F.array_join(F.transform(H.bit_array(H.hash_bits("phash")), lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"))


@query
def url_functions(spark, d):
    p = tables.pins(spark, d, "title", "image_url", "public_id")
    asset = F.concat(F.lit("https://res.cloudinary.com/demo/image/upload/"), F.coalesce("public_id", F.lit("w_10/a")))
    return p.select("id", T.content_disposition("title").alias("header"), T.sized_asset_url(asset, 320).alias("sized"), T.sized_asset_url("image_url").alias("other"), T.is_asset_url(asset).alias("is_asset"))


@query
def seed_ages(spark, d):
    """Times told by ages, in days and in minutes."""
    p = tables.pins(spark, d, "width").filter("width is not null")
    return p.select("id", epoch_ms(seed.days_ago(F.col("width") / 16, X.NOW)).alias("days_ms"), epoch_ms(seed.minutes_ago(F.col("width"), X.NOW)).alias("minutes_ms"))


@query
def seed_addresses(spark, d):
    """The asset's address for one author's uploads, the stored one for others."""
    p = tables.pins(spark, d, "public_id", "image_url", "author_id").withColumnRenamed("image_url", "fallback_url")
    uploaded = p.filter((F.col("author_id") == X.AUTHOR) & F.col("public_id").isNotNull())
    return tables.seed_addresses(p, uploaded, "https://assets.invalid/demo/").select("id", "image_url")


@query
def report_lines(spark, d):
    """A report of the regions, as its lines."""
    out = f"{Scratch(spark, 'report').root}/report"
    sinks.write_report({"Regions": table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")}, out)
    return spark.read.text(out)


@query
def external_image(spark, d):
    return image_by_id(normalise(X.hits(spark, d)), "17").select("provider_id", "title", "width")


@query
def external_normalise(spark, d):
    return normalise(X.hits(spark, d)).select("provider_id", "title", "description", F.size("tags").alias("n_tags"), F.col("credit.name").alias("credit"))


# iterative per image, and streams


@query
def dct_phash(spark, d):
    return images.perceptual_hashes(X.images(spark, d).select("id", "gray")).select("id", "phash")


@query
def kmeans_palette(spark, d):
    found = images.palettes(X.images(spark, d).select("id", "pixels"))
    return found.select("id", F.posexplode("palette").alias("pos", "s"), "iterations", F.round("inertia", 6).alias("inertia")).select("id", "pos", "s.*", "iterations", "inertia")


@query
def kmeans_stats(spark, d):
    """Palettes by the seeds 1 and 999."""
    pics = X.images(spark, d).select("id", "pixels")
    return _round(evaluate.kmeans_stats(images.palettes(pics, seed=1), images.palettes(pics, seed=999)), "mean_iterations", "mean_drift", "max_drift")


@query
def analyse_images(spark, d):
    """Pictures, of which every seventh has no grey matrix and every eleventh no pixels."""
    pics = X.images(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("gray")).alias("gray"), F.when(F.col("id") % 11 != 0, F.col("pixels")).alias("pixels"))
    return images.analyze(pics).select("id", "phash", F.col("palette").isNotNull().alias("has_palette"), "analyzed", F.substring("error", 1, 10).alias("error"))


@query
def edited_copies(spark, d):
    """For each edit, distances of edited pictures to their originals, and whether the hash is made to survive it."""
    every = Scratch(spark, "edits").save(images.edited_hashes(X.images(spark, d, 96)), "hashes")
    originals = every.filter("edit = 'original'").select("pin_id", H.hash_bits("phash").alias("oh"))
    copies = every.filter("edit <> 'original'").join(originals, "pin_id").withColumn("distance", H.hamming(H.hash_bits("phash"), F.col("oh")))
    scope = every.select("edit", "in_scope").distinct()
    return evaluate.group_stats(copies, "edit").join(scope, "edit")


def _stream(spark, d, make, write=live.append_to):
    s = Scratch(spark, "stream")
    s.save(table(spark, d, "comments").select("id", "pin_id", "body", "author", "author_id", F.col("created_at").cast("timestamp").alias("created_at")), "comments")
    out, at = f"{s.root}/out", f"{s.root}/checkpoint"
    rows = make(live.read_comments(spark, f"{s.root}/comments"))
    write(rows, out, at).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query
def comment_stream(spark, d):
    """A pin's live thread, run over the stored comments as a stream until these are used up."""
    pin = tables.comments(spark, d, "pin_id").groupBy("pin_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pin_id").first()["pin_id"]
    return _stream(spark, d, lambda c: live.live_thread(live.accepted(c), pin, "3650 days")).select("id", "body", "author_id")


@query
def comment_stream_daily(spark, d):
    """Comments by day and pin from a stream, run until the stored comments are used up: every day, each comment once."""
    return _stream(spark, d, live.windowed_counts, live.counts_to).select(epoch_ms("start").alias("start_ms"), "pin_id", "comments")
