"""Reads and changes of the stored pins. A change takes the present rows and gives the new ones; nothing is written in place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.color import Rgb, family
from mosaiq.functions.dates import epoch_ms
from mosaiq.functions.text import pin_slug
from mosaiq.operators.filters import every, parse_visibility, text_score, visible_to
from mosaiq.operators.paging import ALL, MOST, clamp, list_pins, newest

# The fields that a list of pins shows, beside the id.
LISTED = (
    "title description image_url thumb_url author author_id created_at source public_id width height provider provider_id "
    "provider_page_url credit tags visibility phash palette color_families analyzed_at"
).split()


_KINDS = {"width": "double", "height": "double", "created_at": "timestamp", "analyzed_at": "timestamp", "tags": "array<string>", "color_families": "array<string>", "palette": "array<struct<r:int,g:int,b:int,hex:string,share:double>>"}


def _listed(columns: list[str]) -> list[Column]:
    return [F.col(c) if c in columns else F.lit(None).cast(_KINDS.get(c, "string")).alias(c) for c in LISTED]


def list_view(pins: DataFrame) -> DataFrame:
    """id and the 21 listed fields, null where the table lacks one; any other column is left out."""
    return pins.select("id", *_listed(pins.columns))


def board(pins: DataFrame, author: str, sort: str = "newest", limit: int = MOST) -> DataFrame:
    """The author's newest pins, at most `limit`, private ones too; these sorted newest or oldest first, or by title.

    Titles are in the Unicode order of a dictionary, equal ones newest first. An unknown sort is newest.
    """
    page = list_pins(pins, author=author, viewer=author, limit=limit).rows
    if sort == "oldest":
        return page.orderBy("created_at", "id")
    if sort == "title":
        return page.orderBy(F.collate("title", "UNICODE"), F.desc("created_at"), F.desc("id"))
    return page.orderBy(F.desc("created_at"), F.desc("id"))


def private_count(pins: DataFrame, author: str, limit: int = MOST) -> DataFrame:
    """How many pins of the author's board are private."""
    return board(pins, author, limit=limit).agg(F.count_if(F.col("visibility") == "private").alias("private_pins"))


def pin_view(pins: DataFrame) -> DataFrame:
    """Stored rows as they are shown: times in milliseconds, a missing source told from the upload's id, missing visibility public."""
    source = F.coalesce("source", F.when(F.coalesce("public_id", F.lit("")) != "", "upload").otherwise("link"))
    columns = [c for c in pins.columns if c not in ("created_at", "analyzed_at", "source", "visibility")]
    return pins.select(*columns, epoch_ms("created_at").alias("created_at"), epoch_ms("analyzed_at").alias("analyzed_at"), source.alias("source"), F.coalesce("visibility", F.lit("public")).alias("visibility"))


def pins_by_ids(pins: DataFrame, ids: DataFrame, *, viewer: str | None = None, limit: int = ALL) -> DataFrame:
    """The visible pins whose id is in ids, newest first; other ids are passed over."""
    return newest(pins.filter(visible_to(viewer)).join(ids.select("id").distinct(), "id", "left_semi"), limit)


def find_by_tags(pins: DataFrame, tags: list[str], *, exclude: str | None = None, limit: int | None = 12) -> DataFrame:
    """Public pins sharing tags (as they are stored), most shared first, then newest, then id falling; with `overlap`."""
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    rows = pins.filter(every(visible_to(), F.arrays_overlap("tags", wanted), F.col("id") != exclude if exclude is not None else None))
    rows = rows.withColumn("overlap", F.size(F.array_intersect("tags", wanted)))
    return rows.orderBy(F.desc("overlap"), F.desc("created_at"), F.desc("id")).limit(clamp(limit, 12))


def search_pins(pins: DataFrame, query: str, *, viewer: str | None = None, limit: int | None = None) -> DataFrame:
    """Visible pins with a token of the query, by text_score, then newest, then id falling; with `score`."""
    rows = pins.filter(visible_to(viewer)).withColumn("score", text_score(query)).filter("score > 0")
    return rows.orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(clamp(limit))


def pin_hashes(pins: DataFrame, *, viewer: str | None = None, limit: int | None = ALL) -> DataFrame:
    rows = pins.filter(every(visible_to(viewer), F.col("phash").isNotNull())).select("id", "phash", "title", "image_url")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def pins_with_palette(pins: DataFrame, *, families: list[str] | None = None, viewer: str | None = None, limit: int = ALL) -> DataFrame:
    wanted = F.arrays_overlap("color_families", F.array(*[F.lit(f) for f in families])) if families else None
    return newest(pins.filter(every(visible_to(viewer), F.col("palette").isNotNull(), wanted)), limit)


def unanalysed(pins: DataFrame, limit: int | None = 25) -> DataFrame:
    """Pins that the analysis hasn't seen, oldest first; whoever owns them."""
    return pins.filter(F.col("analyzed_at").isNull()).orderBy("created_at", "id").limit(max(1, 25 if limit is None else limit))


def count_pins(pins: DataFrame, author: str | None = None) -> DataFrame:
    """An author's pins, private ones too; or all public ones."""
    return pins.filter(visible_to() if author is None else F.col("author_id") == author).agg(F.count(F.lit(1)).alias("pins"))


def analysis_coverage(pins: DataFrame, viewer: str | None = None) -> DataFrame:
    """total, analyzed (with a hash) and their ratio, 1 of nothing; in one pass."""
    out = pins.filter(visible_to(viewer)).agg(F.count(F.lit(1)).alias("total"), F.count("phash").alias("analyzed"))
    return out.withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.col("analyzed") / F.col("total")))


def insert_absent(present: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """present and those rows of new whose keys it lacks, a key's first row only (by all columns); a null in a key never clashes."""
    given = every(*(F.col(k).isNotNull() for k in keys))
    order = [F.col(c) for c in new.columns if c not in keys]
    best = F.min_by(F.struct(*new.columns), F.struct(*order)) if order else F.min(F.struct(*new.columns))
    fresh = new.filter(given).groupBy(*keys).agg(best.alias("row")).select("row.*")
    return present.unionByName(fresh.join(present.select(*keys), keys, "left_anti")).unionByName(new.filter(~given))


def create_pins(stored: DataFrame, new: DataFrame, *, now: int, suffix: Column | None = None) -> dict[str, DataFrame]:
    """`created`, the new pins as they are stored, and `already_saved`, those whose source image their author has saved.

    new: title, image_url, author_id and any of the other listed fields; stored: author_id, provider, provider_id. The id
    is made of the title and a suffix (six random hex digits unless a column is given), the source, if missing, is upload
    with a public_id and link without, visibility public; an empty array of tags is null; created_at is `now` in
    milliseconds. An author saves an image of a provider, told by a provider_id, once (a missing provider is one of its
    own): of rows within `new` that clash, the first by all columns is created. Rows without a provider_id never clash.
    """
    suffix = F.substring(F.expr("replace(uuid(), '-')"), 1, 6) if suffix is None else suffix
    rows = new.select(*_listed(new.columns), suffix.alias("_suffix"))
    key, given = ["author_id", "provider", "provider_id"], F.col("provider_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in LISTED if c not in key]))
    there = stored.filter(given).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct().withColumn("_there", F.lit(True))
    tried = rows.filter(given).withColumn("_nth", nth).join(there, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left")
    tried = tried.select(*LISTED, "_suffix", (F.col("_there").isNotNull() | (F.col("_nth") > 1)).alias("_clash"))
    tried = tried.unionByName(rows.filter(~given).withColumn("_clash", F.lit(False)))
    source = F.coalesce("source", F.when(F.coalesce("public_id", F.lit("")) != "", "upload").otherwise("link"))
    made = {"source": source, "visibility": F.coalesce("visibility", F.lit("public")), "created_at": F.timestamp_millis(F.lit(now)), "tags": F.when(F.size("tags") > 0, F.col("tags"))}
    created = tried.filter(~F.col("_clash")).select(pin_slug("title", F.col("_suffix")).alias("id"), *[made.get(c, F.col(c)).alias(c) for c in LISTED])
    return {"created": created, "already_saved": tried.filter("_clash").select(*[c for c in LISTED if c in new.columns])}


def upsert(present: DataFrame, new: DataFrame, key: str = "id", *, force: bool = False) -> DataFrame:
    """Inserts what is absent; with force, new rows replace present ones of the same key."""
    if not force:
        return insert_absent(present, new, [key])
    return present.join(new.select(key), key, "left_anti").select(*present.columns).unionByName(new.dropDuplicates([key]))


def set_analysis(pins: DataFrame, results: DataFrame) -> DataFrame:
    """pins with the phash, palette and colour families of results (id, phash, palette, analyzed_at).

    A missing result keeps the present value; the time of the analysis is always taken.
    """
    new = results.select(F.col("id"), F.col("phash").alias("_phash"), F.col("palette").alias("_palette"), F.col("analyzed_at").alias("_at"))
    families = F.array_distinct(F.transform("_palette", _family))
    out = pins.join(new, "id", "left")
    changed = {"phash": F.coalesce("_phash", "phash"), "palette": F.coalesce("_palette", "palette"), "color_families": F.coalesce(families, F.col("color_families")), "analyzed_at": F.coalesce("_at", "analyzed_at")}
    return out.withColumns(changed).select(*pins.columns)


def store_analysis(pins: DataFrame, analysed: DataFrame) -> DataFrame:
    """set_analysis of the results (id, phash, palette, analyzed, analyzed_at) where something was found; the others aren't stamped.

    For an analysis within the request, which is tried again later if it fails; set_analysis itself stamps every result,
    as a job in the background does that must not try the same image forever.
    """
    return set_analysis(pins, analysed.filter("analyzed").select("id", "phash", "palette", "analyzed_at"))


def _family(swatch: Column) -> Column:
    return family(Rgb(swatch["r"], swatch["g"], swatch["b"]))


def set_visibility(pins: DataFrame, row_id, author: str, value: str) -> DataFrame:
    """The owner's change; anyone else's, and an unknown id, change nothing."""
    own = (F.col("id") == row_id) & (F.col("author_id") == author)
    return pins.withColumn("visibility", F.when(own, F.lit(value)).otherwise(F.col("visibility")))


def backfill_visibility(pins: DataFrame) -> DataFrame:
    return pins.withColumn("visibility", F.coalesce("visibility", F.lit("public")))


def normal_visibility(pins: DataFrame) -> DataFrame:
    return pins.withColumn("visibility", parse_visibility("visibility"))


def delete_pins(pins: DataFrame, saves: DataFrame, comments: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Removes the pins of gone (id, author_id) that their author owns, with their saves and comments; `assets` are the uploads to remove."""
    doomed = pins.join(gone.select("id", "author_id").distinct(), ["id", "author_id"], "left_semi")
    ids = doomed.select("id")
    assets = doomed.filter((F.col("source") == "upload") & F.col("public_id").isNotNull()).select("public_id")
    return {"pins": pins.join(ids, "id", "left_anti"), "saves": forget_pins(saves, ids)["left"], "comments": forget_pins(comments, ids)["left"], "assets": assets}


def forget_pins(rows: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """`left`, the rows (saves, comments) whose pin_id isn't in ids, and `removed`, how many others there were for each pin of ids.

    Rows without a pin_id stay; a pin without rows has 0; an id that occurs twice counts once.
    """
    gone = ids.select(F.col("id").alias("pin_id")).filter("pin_id is not null").distinct()
    counts = rows.groupBy("pin_id").agg(F.count(F.lit(1)).alias("n"))
    removed = gone.join(counts, "pin_id", "left").select("pin_id", F.coalesce("n", F.lit(0)).alias("removed"))
    return {"left": rows.join(gone, "pin_id", "left_anti"), "removed": removed}


def toggle_saves(saves: DataFrame, toggles: DataFrame) -> DataFrame:
    """Each (user_id, pin_id) of toggles is added if absent and removed if present; repeated toggles apply one after the other."""
    odd = toggles.groupBy("user_id", "pin_id").agg((F.count(F.lit(1)) % 2).alias("n")).filter("n = 1").select("user_id", "pin_id", F.lit(1).alias("t"))
    state = saves.select("user_id", "pin_id").distinct().withColumn("s", F.lit(1))
    return state.join(odd, ["user_id", "pin_id"], "full_outer").filter("s is null or t is null").select("user_id", "pin_id")
