"""Text as Columns: tokens, stems, slugs, names and sizes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, in their groups.
STOP_WORDS = (
    "a all an and any are as be been being both but can could did do does each for had has have her here his how i if is it "
    "its just may might more most much must my no nor not one only or other our own same she should so some such than that the "
    "their them then there these they this those too very was we were what when where which while who why will with would you your "
    "about above across after against along among around at because before behind below beneath beside between beyond by down during "
    "from in inside into near of off on onto out outside over past through throughout to toward towards under until up upon within without"
).split()


# Words longer than so many letters with an ending, but not with another, lose letters and get an ending.
STEMS = ((4, "ies", None, 3, "y"), (4, "es", None, 2, ""), (3, "s", "ss", 1, ""))


def stem(word: Column) -> Column:
    """cities -> city, beaches -> beach, dunes -> dun, trees -> tre, glass stays; the first rule that fits."""
    out, n = word, F.length(word)
    for longer, ending, other, lost, new in reversed(STEMS):
        fits = (n > longer) & F.endswith(word, F.lit(ending))
        if other:
            fits = fits & ~F.endswith(word, F.lit(other))
        short = F.substring(word, F.lit(1), n - lost)
        out = F.when(fits, F.concat(short, F.lit(new)) if new else short).otherwise(out)
    return out


def stem_of(word: str) -> str:
    """stem of one word, for literals."""
    for longer, ending, other, lost, new in STEMS:
        if len(word) > longer and word.endswith(ending) and not (other and word.endswith(other)):
            return word[:-lost] + new
    return word


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, longer than two, no stop words, stemmed after that; null gives []."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS if len(w) > 2])
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.transform(kept, stem)


def document_text(title: Column | str = "title", description: Column | str = "description") -> Column:
    """What counts as a pin's content: title and description; author and tags don't."""
    title, description = (F.col(c) if isinstance(c, str) else c for c in (title, description))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def normal_tags(tags: Column | str) -> Column:
    """Comma-separated tags of an external image: trimmed, lower-cased, without empty ones and repeats, first kept."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def search_queries(tags: Column) -> Column:
    """The queries for images like one with these tags: its first three, two and one, each once."""
    usable = F.slice(F.filter(tags, lambda t: t != ""), 1, 3)
    return F.array_distinct(F.filter(F.array(F.concat_ws(" ", usable), F.concat_ws(" ", F.slice(usable, 1, 2)), F.concat_ws(" ", F.slice(usable, 1, 1))), lambda q: q != ""))


def pin_slug(title: Column | str, suffix: Column) -> Column:
    """A readable id: at most 48 characters of the title, one dash trimmed at each end before that, and the suffix."""
    title = F.col(title) if isinstance(title, str) else title
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)
    return F.concat(F.when(F.coalesce(slug, F.lit("")) == "", "pin").otherwise(slug), F.lit("-"), suffix)


def file_slug(title: Column | str, default: str = "image") -> Column:
    title = F.col(title) if isinstance(title, str) else title
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.when(F.coalesce(slug, F.lit("")) == "", default).otherwise(slug)


def content_disposition(name: Column | str) -> Column:
    """An attachment header: an ASCII name without quotes and backslashes, and the full name percent-encoded."""
    name = F.col(name) if isinstance(name, str) else name
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7e]", ""), r'["\\]', "")
    # form encoding differs from percent encoding in the space and five marks
    coded = F.url_encode(name)
    for form, mark in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.regexp_replace(coded, form, mark)
    return F.concat(F.lit('attachment; filename="'), F.when(plain == "", "image").otherwise(plain), F.lit("\"; filename*=UTF-8''"), coded)


_ASSET = r"^(https?://res\.cloudinary\.com/[^/]+/image/upload/)(.+)$"  # a fixed format of asset addresses


def is_asset_url(url: Column | str) -> Column:
    return F.col(url).rlike(_ASSET) if isinstance(url, str) else url.rlike(_ASSET)


def sized_asset_url(url: Column | str, width: int | None = None, quality: str = "auto") -> Column:
    """The address of a resized asset; any other address, and one that has been transformed, stays."""
    url = F.col(url) if isinstance(url, str) else url
    parts = ["f_auto", f"q_{quality}", "c_limit", *([f"w_{int(width + 0.5)}"] if width else []), "dpr_auto"]
    rest = F.regexp_extract(url, _ASSET, 2)
    return F.when(url.rlike(_ASSET) & ~rest.rlike("^[a-z]_[^/]*/"), F.concat(F.regexp_extract(url, _ASSET, 1), F.lit(",".join(parts) + "/"), rest)).otherwise(url)


def byte_size(n: Column | str) -> Column:
    """512 B, 3 KB, 2.5 MB."""
    n = F.col(n) if isinstance(n, str) else n
    mb = F.floor(n / 1048576 * 10 + 0.5).cast("long")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.floor(n / 1024 + 0.5).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.floor(mb / 10).cast("long").cast("string"), F.lit("."), (mb % 10).cast("string"), F.lit(" MB")))
    )
