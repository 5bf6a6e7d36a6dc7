"""External image search: results as JSON files or as a table, normalised to one shape. There is no network here."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mosaiq.functions.text import capitalised, normal_tags

HIT = "id bigint, pageURL string, tags string, previewURL string, webformatURL string, largeImageURL string, imageWidth int, imageHeight int, user string"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """One hit a row from files of answers {"hits": [...]}; the page is the file's, place the hit's position in it."""
    rows = spark.read.schema(f"hits array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in HIT.split(', ')))}>>").option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("page"), F.posexplode("hits").alias("place", "hit")).select("page", "place", "hit.*")


def normalise(hits: DataFrame) -> DataFrame:
    """(provider_id, title, description, tags, thumb_url, image_url, large_url, width, height, page_url, credit).

    The title is the first tag, capitalised, or Untitled; the description all tags.
    """
    tags = normal_tags("tags")
    first = F.element_at(F.concat(tags, F.array(F.lit(""))), 1)
    return hits.select(
        F.col("id").cast("string").alias("provider_id"), F.when(first == "", "Untitled").otherwise(capitalised(first)).alias("title"), F.concat_ws(", ", tags).alias("description"),
        tags.alias("tags"), F.col("previewURL").alias("thumb_url"), F.col("webformatURL").alias("image_url"), F.col("largeImageURL").alias("large_url"),
        F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.col("pageURL").alias("page_url"), F.struct(F.col("user").alias("name")).alias("credit"),
    )


def search_request(query: str, page: int = 1, per_page: int = 24) -> dict | None:
    """What is asked for: a trimmed query, a page from 1, 3 to 200 results a page; None for an empty query."""
    query = query.strip()
    return {"q": query, "page": max(1, page), "per_page": max(3, min(200, per_page)), "image_type": "photo", "safesearch": "true", "order": "popular"} if query else None


def image_by_id(images: DataFrame, provider_id: str) -> DataFrame:
    """The image of an id of digits; no row for anything else."""
    ok = provider_id.isascii() and provider_id.isdigit()
    return images.filter((F.col("provider_id") == provider_id) & F.lit(ok)).limit(1)


class ImageSearch(DataSource):
    """spark.read.format("image_search").option("queries", json list).option("folder", ...).load(): saved answers by query and page.

    One input partition a query, so that queries are fetched in parallel. A fetcher of (query, page, per_page) -> list of hits can be set
    as ImageSearch.fetch before registration; the default reads <folder>/<query>-<page>.json and gives nothing where that is
    missing.
    """

    fetch: Callable[[dict, str], list[dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "image_search"

    def schema(self) -> str:
        return "query string, page int, place int, " + HIT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).fetch)


class _Reader(DataSourceReader):
    def __init__(self, options, fetch):
        self.requests = [r for q in json.loads(options.get("queries", "[]")) if (r := search_request(q, int(options.get("page", 1)), int(options.get("per_page", 24))))]
        self.folder, self.fetch = options.get("folder", "."), fetch

    def partitions(self):
        return [InputPartition(r) for r in self.requests]

    def read(self, partition) -> Iterator[tuple]:
        r = partition.value
        if self.fetch is not None:
            hits = self.fetch(r, self.folder)
        else:
            try:
                with open(f"{self.folder}/{r['q']}-{r['page']}.json") as f:
                    hits = json.load(f).get("hits", [])
            except FileNotFoundError:
                hits = []
        fields = [x.split()[0] for x in HIT.split(", ")]
        for place, hit in enumerate(hits[: r["per_page"]]):
            yield (r["q"], r["page"], place, *(hit.get(f) for f in fields))
