"""Row filters: who may see a row, paging predicates, windows of time, search terms, validation."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import text as T
from mosaiq.functions.dates import DAY_MS, epoch_ms

# What a pin's visibility and source may be, days of the windows, types and providers that are accepted, and limits of fields.
VISIBILITIES = ("public", "private")
SOURCES = ("seed", "upload", "link")
WINDOWS = {"week": 7, "month": 30, "all": None}
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/avif")
PROVIDERS = ("pixabay",)
MOST_UPLOAD = 10 * 1024 * 1024
STORED_TITLE, STORED_DESCRIPTION, STORED_SWATCHES = 200, 2000, 12
FORM_TITLE, FORM_DESCRIPTION, FORM_COMMENT = 120, 500, 1000


def every(*conditions: Column | None) -> Column:
    """All of the given conditions; true if there is none."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else F.lit(True)


def parse_visibility(value: Column | str) -> Column:
    """Unknown and missing values are public."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isin(*VISIBILITIES), value).otherwise("public")


def visible_to(viewer: str | None = None, visibility: str = "visibility", author: str = "author_id") -> Column:
    """A filter for public rows and the viewer's own; without a viewer (or with an empty one), for public rows only.

    A row whose visibility is missing isn't public until store.backfill_visibility has filled it; only its author sees it.
    """
    public = F.col(visibility) == "public"
    return public | (F.col(author) == viewer) if viewer else public


def after(ms: int, row_id, created: str = "created_at", id_col: str = "id") -> Column:
    """Rows behind a cursor in the order newest first, id falling."""
    at = epoch_ms(created)
    return (at < ms) | ((at == ms) & (F.col(id_col) < row_id))


def in_window(window: str, now: int, created: str = "created_at") -> Column | None:
    days = WINDOWS[window]
    return None if days is None else epoch_ms(created) >= now - days * DAY_MS


def matches(query: str, title: str = "title", description: str = "description") -> Column:
    """Every token of the query begins some token of the row; a query without tokens is looked for as it is, in any case."""
    document = T.document_text(title, description)
    needles = _query_tokens(query)
    if not needles:
        return F.contains(F.lower(document), F.lit(query.strip().lower()))
    words = T.tokens(document)
    return every(*[_begins(words, n) for n in needles])


def _begins(words: Column, needle: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(needle)))


def _query_tokens(query: str) -> list[str]:
    """T.tokens for a literal."""
    out = []
    for w in re.split("[^a-z0-9]+", query.lower()):
        if len(w) > 2 and w not in T.STOP_WORDS:
            out.append(T.stem_of(w))
    return out


def text_score(query: str, title: str = "title", description: str = "description") -> Column:
    """Of the query's distinct tokens: five for each occurrence in the title, one in the description."""
    needles = sorted(set(_query_tokens(query)))
    if not needles:
        return F.lit(0)
    wanted = F.array(*[F.lit(n) for n in needles])
    hits = lambda c: F.size(F.filter(T.tokens(c), lambda w: F.array_contains(wanted, w)))
    return 5 * hits(title) + hits(description)


def accepted_upload(mime: Column, size: Column, most: int = MOST_UPLOAD) -> Column:
    return mime.isin(*IMAGE_TYPES) & (size <= most)


def form_errors(rows: DataFrame) -> DataFrame:
    """The rows with `errors`, the fields of a form (title, description, body, mime with size; those there are) that it refuses.

    Texts are trimmed of white space. A title and a comment's body are required, a description isn't; a missing file is
    no error.
    """
    size = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    fits = {"title": lambda: size("title").between(1, FORM_TITLE), "description": lambda: size("description") <= FORM_DESCRIPTION, "body": lambda: size("body").between(1, FORM_COMMENT)}
    fits["mime"] = lambda: F.col("mime").isNull() | accepted_upload(F.col("mime"), F.col("size"))
    errors = [F.when(~F.coalesce(ok(), F.lit(False)), c) for c, ok in fits.items() if c in rows.columns]
    return rows.withColumn("errors", F.array_compact(F.array(*errors).cast("array<string>")))


def _length_within(name: str, least: int, most: int) -> Column:
    return F.col(name).isNull() | F.length(name).between(least, most)


def _swatch_fits(s: Column) -> Column:
    channels = reduce(and_, [s[c].between(0, 255) for c in ("r", "g", "b")])
    return F.coalesce(channels & s["hex"].rlike(r"^#[0-9a-f]{6}\z") & s["share"].between(0, 1), F.lit(False))


def rules(columns: list[str], providers: tuple[str, ...] = PROVIDERS) -> dict[str, Column]:
    """The rules of a stored pin that apply to the given columns; each holds for a null unless the column is required."""
    url = lambda c: F.col(c).isNull() | F.col(c).rlike("^https?://")
    one_of = lambda c, *v: F.col(c).isNull() | F.col(c).isin(*v)
    checks = {
        "title_length": ("title", lambda: _length_within("title", 1, STORED_TITLE)),
        "description_length": ("description", lambda: _length_within("description", 0, STORED_DESCRIPTION)),
        "image_url_format": ("image_url", lambda: url("image_url")),
        "thumb_url_format": ("thumb_url", lambda: url("thumb_url")),
        "phash_format": ("phash", lambda: F.col("phash").isNull() | F.col("phash").rlike(r"^[0-9a-f]{16}\z")),
        "source_known": ("source", lambda: one_of("source", *SOURCES)),
        "visibility_known": ("visibility", lambda: one_of("visibility", *VISIBILITIES)),
        "provider_known": ("provider", lambda: one_of("provider", *providers)),
        "palette_size": ("palette", lambda: F.col("palette").isNull() | (F.size("palette") <= STORED_SWATCHES)),
        "palette_colors": ("palette", lambda: F.col("palette").isNull() | F.forall("palette", _swatch_fits)),
    }
    out = {f"{c}_present": F.col(c).isNotNull() for c in ("id", "title", "image_url", "author_id", "created_at") if c in columns}
    return out | {name: make() for name, (column, make) in checks.items() if column in columns}


def validate(rows: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """The rows with `broken`, the names of the rules each breaks; an empty array for a valid one."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules(rows.columns, providers).items()]
    return rows.withColumn("broken", F.array_compact(F.array(*broken)))
