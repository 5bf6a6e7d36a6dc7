"""Problem 4: new batches against all history, by an index of the history's hashes that is only ever appended to.

The method is multi-index hashing. A table of distances to whole-hash pivots was measured and prunes too little at this
radius; README has the figures.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.skew import HOT_ROWS, hot_keys, hot_limit, skew_join
from mosaiq.runtime import Scratch

#: A band's number is above its cell in one 64-bit key.
BAND_SHIFT = 58
#: What a probe costs, which is made, moved and sorted, in pairs that are compared.
PROBE_COST = 20
#: Probes that are sent to all tasks instead of being moved to the history's buckets; 16 bytes each.
BROADCAST_PROBES = 250_000
#: Author and time keys that are looked up by reading only their buckets.
FEW_KEYS = 1_000
#: Rows of a bucket, about.
BUCKET_ROWS = 1_000_000
#: A segment is merged with the one before it unless that has more than so many times its rows.
MERGE = 4
#: Rows of a crowded cell that are tried before the others.
TRIED = 64
#: Probes that one task makes.
PER_TASK = 1_500_000

Band = tuple[int, int, int]


def valid_hash(phash: Column | str) -> Column:
    """The 64-bit number of a hash of exactly 16 lower-case hex digits; null for any other value."""
    c = F.col(phash) if isinstance(phash, str) else phash
    return F.when(c.rlike(r"^[0-9a-f]{16}\z"), F.conv(c, 16, -10).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def bands(limit: int, count: int) -> list[Band]:
    """(shift, width, radius) of `count` bands of the 64 bits, the sum of radius + 1 being limit + 1."""
    if not 1 <= count <= limit + 1:
        raise ValueError("needs between 1 and limit + 1 bands")
    more, spare = divmod(limit + 1 - count, count)
    out, shift = [], 0
    for i in range(count):
        width = 64 // count + (i < 64 % count)
        out.append((shift, width, min(width, more + (i < spare))))
        shift += width
    return out


def probes_of(plan: list[Band]) -> int:
    """Cells around one hash."""
    return sum(comb(w, k) for _, w, r in plan for k in range(r + 1))


def band_count(limit: int, rows: int) -> int:
    """The number of bands of least cost for a probe of so many random hashes: few bands need more probes, many leave more pairs.

    Widths so grow with the logarithm of the history: five bands for a hundred thousand hashes at 10 bits, four for a million.
    """

    def cost(count: int) -> float:
        return sum((PROBE_COST + rows / 2.0**w) * comb(w, k) for _, w, r in bands(limit, count) for k in range(r + 1))

    return min((c for c in range(1, limit + 2) if probes_of(bands(limit, c)) <= 5_000), key=cost)


def cells(hashes: DataFrame, name: str, plan: list[Band], around: bool) -> DataFrame:
    """(name, at) for the cells of each hash (column hash), a band each, or for all cells within the bands' radii."""
    each = []
    for band, (shift, width, radius) in enumerate(plan):
        cell = F.col("hash") if width == 64 else F.shiftrightunsigned("hash", shift).bitwiseAND((1 << width) - 1)
        key = cell.bitwiseOR(F.lit(band << BAND_SHIFT)) if len(plan) > 1 else cell
        flips = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)] if around else [0]
        each.append(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), key.bitwiseXOR))
    return hashes.select("hash", F.explode(F.concat(*each)).alias("at")).select(F.col("hash").alias(name), "at")


def probes_for(s: Scratch, hashes: DataFrame, plan: list[Band], name: str) -> DataFrame:
    """The probes of distinct hashes, made in many tasks, as each hash gives hundreds."""
    tasks = -(-hashes.count() * probes_of(plan) // PER_TASK) or 1
    return s.save(cells(hashes.repartition(tasks, "hash"), "probe", plan, True), name)


def _exists(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may have ended, and its names with it
        pass


def _register(spark: SparkSession, path: str, kinds: str, column: str, buckets: int) -> str:
    """A name for a bucketed folder, without which Spark doesn't use its buckets; the name goes with the application, the files stay."""
    name = f"mosaiq_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}'")
    atexit.register(_drop, spark, name)
    return name


def _write(df: DataFrame, path: str, column: str, buckets: int) -> None:
    """Writes a bucketed and sorted folder, one file a bucket; a folder left by a failed attempt is replaced."""
    name = f"mosaiq_{uuid.uuid4().hex}"
    p, fs = _exists(df.sparkSession, path)
    fs.delete(p, True)
    rows = df.repartition(buckets, column).sortWithinPartitions(column)
    rows.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd").saveAsTable(name)
    _drop(df.sparkSession, name)


@dataclass
class Segment:
    """Appends first to last, in files of their own: `hashes` (hash, at) bucketed by at, `keys` (key, author_id, created_at) by key."""

    spark: SparkSession
    root: str
    first: int
    last: int
    limit: int
    count: int
    buckets: int
    names: dict[str, str] = field(default_factory=dict)

    @property
    def folder(self) -> str:
        return f"{self.root}/seg-{self.first:09}-{self.last:09}-limit-{self.limit}-bands-{self.count}-buckets-{self.buckets}"

    @staticmethod
    def of(spark: SparkSession, root: str, name: str) -> Segment:
        first, last, limit, count, buckets = (int(x) for x in name.split("-") if x.isdigit())
        return Segment(spark, root, first, last, limit, count, buckets)

    @property
    def plan(self) -> list[Band]:
        return bands(self.limit, self.count)

    def table(self, kind: str) -> DataFrame:
        if kind not in self.names:
            # a bucketed folder without rows has no file to tell its columns
            fields = "hash bigint, at bigint" if kind == "hashes" else ", ".join(f"{n} {t}" for n, t in self.spark.read.parquet(f"{self.folder}/kinds").dtypes)
            self.names[kind] = _register(self.spark, f"{self.folder}/{kind}", fields, "at" if kind == "hashes" else "key", self.buckets)
        return self.spark.table(self.names[kind])

    def hashes(self) -> DataFrame:
        """Each hash once: the first band's rows."""
        return self.table("hashes").filter(F.shiftrightunsigned("at", BAND_SHIFT) == 0 if self.count > 1 else F.lit(True)).select("hash")

    def crowded(self) -> dict[int, int]:
        """Cells with so many hashes that they are joined in blocks, and their numbers of hashes; written with the segment."""
        return {r["at"]: r["rows"] for r in self.spark.read.schema("at bigint, rows bigint").parquet(f"{self.folder}/crowded").collect()}

    def complete(self) -> bool:
        p, fs = _exists(self.spark, f"{self.folder}/keys/_SUCCESS")
        return fs.exists(p)


class History:
    """What has been accepted so far: hashes in an index of bands, and pairs (author_id, created_at).

    It lies at `path`, where any later application can open it, or else in the scratch folder for as long as that lasts.
    An append writes one segment, whose bands are sized to its hashes; small segments are merged, so that there are only
    as many as the logarithm of the history's size and a row is rewritten as seldom. Files never change; a segment counts
    once its last table is complete. One application writes at a time.

    Two hashes that differ in at most `limit` bits differ, in at least one band, by at most that band's radius. A batch
    therefore asks for the cells around each of its hashes, and compares the hashes it finds there. A segment is bucketed
    by cell: a batch's probes are sent to the buckets, or, if they are few, to all tasks; the history is read in place and
    neither moved nor written. A batch of more than a few hashes has probes for every bucket, so that it reads the whole
    index once; by author and time only the buckets of its keys are read.
    """

    def __init__(self, s: Scratch, limit: int = 10, path: str | None = None):
        self.s, self.limit, self.spark = s, limit, s.spark
        self.root = path.rstrip("/") if path else f"{s.root}/history"
        p, fs = _exists(self.spark, self.root)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        found = [Segment.of(self.spark, self.root, n) for n in names if n.startswith("seg-")]
        found = [x for x in found if x.complete()]
        if any(x.limit != limit for x in found):
            raise ValueError(f"the history at {path} is of another limit: {found[0].folder}")
        # a merged segment holds all of those within it, which may not have been removed yet
        self.segments = sorted((x for x in found if not any(y is not x and y.first <= x.first and x.last <= y.last for y in found)), key=lambda x: x.first)
        self.turn = 0

    def _write(self, first: int, last: int, hashes: DataFrame, keys: DataFrame) -> Segment:
        """A segment of distinct hashes and keys (tables, as they are counted first)."""
        rows = hashes.count()
        count = band_count(self.limit, rows)
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(partitions, -(-max(rows * count, keys.count()) // BUCKET_ROWS))
        seg = Segment(self.spark, self.root, first, last, self.limit, count, buckets)
        _write(cells(hashes, "hash", seg.plan, False), f"{seg.folder}/hashes", "at", buckets)
        least = hot_limit(rows, buckets, HOT_ROWS)
        crowded = seg.table("hashes").groupBy("at").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > least)
        crowded.coalesce(1).write.mode("overwrite").parquet(f"{seg.folder}/crowded")
        keys = keys.select(F.xxhash64("author_id", "created_at").alias("key"), "author_id", "created_at")
        keys.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{seg.folder}/kinds")
        _write(keys, f"{seg.folder}/keys", "key", buckets)
        return seg

    def append(self, rows: DataFrame) -> None:
        """rows: hash, author_id, created_at; nulls in any of them are no entry."""
        s, self.turn = self.s.part("append"), self.turn + 1
        hashes = s.save(rows.filter("hash is not null").select("hash").distinct(), "hashes")
        keys = s.save(rows.filter("author_id is not null and created_at is not null").select("author_id", "created_at").distinct(), "keys")
        number = self.segments[-1].last + 1 if self.segments else 0
        self.segments.append(self._write(number, number, hashes, keys))
        s.close()
        while len(self.segments) > 1:
            a, b = self.segments[-2:]
            if a.hashes().count() + a.table("keys").count() > MERGE * (b.hashes().count() + b.table("keys").count()):
                break
            s = self.s.part("merge")
            hashes = s.save(a.hashes().unionByName(b.hashes()).distinct(), "hashes")
            keys = s.save(a.table("keys").unionByName(b.table("keys")).select("author_id", "created_at").distinct(), "keys")
            self.segments[-2:] = [self._write(a.first, b.last, hashes, keys)]
            s.close()
            for old in (a, b):
                for name in old.names.values():
                    _drop(self.spark, name)
                p, fs = _exists(self.spark, old.folder)
                fs.delete(p, True)

    def near(self, hashes: DataFrame) -> DataFrame:
        """(hash) of those distinct hashes (a table) that are within the limit of an accepted one."""
        out, s = None, self.s.part("near")
        for i, seg in enumerate(self.segments):
            found = self._near(s, hashes, seg, i)
            out = found if out is None else out.unionByName(found)
        return out.distinct() if out is not None else hashes.limit(0)

    def _near(self, s: Scratch, hashes: DataFrame, seg: Segment, i: int) -> DataFrame:
        probes, there = probes_for(s, hashes, seg.plan, f"probes-{i}"), seg.table("hashes")
        close = hamming("probe", "hash") <= self.limit
        number = probes.count()
        if number <= BROADCAST_PROBES:  # counted just now
            return there.join(F.broadcast(probes), "at").filter(close).select(F.col("probe").alias("hash"))
        limit = hot_limit(number, seg.buckets, HOT_ROWS)
        crowded = seg.crowded()
        hot = crowded.keys() | {at for (at,) in hot_keys(probes, ["at"], limit)}
        if not hot:
            return there.join(probes, "at").filter(close).select(F.col("probe").alias("hash"))
        # fewer cells than twice the buckets; of a crowded cell some hashes are tried first, as one near hash is enough
        cut = self.spark.createDataFrame([(a, max(1, crowded.get(a, 1) // TRIED)) for a in hot], "at bigint, step bigint")
        cold = there.join(probes.join(F.broadcast(cut), "at", "left_anti"), "at").filter(close).select(F.col("probe").alias("hash"))
        asked = s.save(probes.join(F.broadcast(cut.select("at")), "at"), f"asked-{i}")
        held = s.save(there.join(F.broadcast(cut), "at"), f"held-{i}")
        first = skew_join(asked, held.filter(F.pmod(F.xxhash64("hash"), "step") == 0), ["at"]).filter(close).select("probe").distinct()
        first = s.save(first, f"first-{i}")
        rest = s.save(skew_join(asked, first, ["probe"], "left_anti"), f"rest-{i}")
        hot_found = skew_join(rest, held, ["at"]).filter(close).select(F.col("probe").alias("hash"))
        return cold.unionByName(hot_found).unionByName(first.withColumnRenamed("probe", "hash"))

    def known(self, keys: DataFrame) -> DataFrame:
        """The distinct (author_id, created_at) of keys (a table) that have been accepted."""
        on, asked = ["author_id", "created_at"], keys.withColumn("key", F.xxhash64("author_id", "created_at"))
        some = None
        if self.segments and asked.count() <= FEW_KEYS:
            some = [r["key"] for r in asked.select("key").distinct().collect()]
        out = keys.limit(0)
        for seg in self.segments:
            there = seg.table("keys") if some is None else seg.table("keys").filter(F.col("key").isin(some))
            found = there.join(asked if some is None else F.broadcast(asked), ["key", *on], "left_semi")  # FEW_KEYS at most
            out = out.unionByName(found.select(*on))
        return out.distinct()

    def check(self, batch: DataFrame) -> DataFrame:
        """The batch with a column `repeats`: whether a row repeats history or an earlier row that doesn't itself.

        batch: arrival_id (the order; rows that repeat one count once), hash, author_id, created_at. A null hash, author
        or time repeats nothing. Append the rows that don't repeat to go on with the next batch; a series of batches gives
        the same result as one batch of all of them.

        First everything near history is settled, by hash class. The rest is settled in rounds: a row with an accepted
        earlier neighbour repeats, a row without an undecided or accepted earlier neighbour is accepted. Of a hash class
        or a key only the smallest accepted and undecided arrival matter, so a round moves one row a class, and a class
        that holds a third of all rows is settled in two rounds. A chain of arrivals, each near the next only, takes a
        round for every second link. Links are between distinct hashes of the batch only.
        """
        s, keyed = self.s.part("check"), "author_id is not null and created_at is not null"
        rows = s.save(batch.select("arrival_id", "hash", "author_id", "created_at").dropDuplicates(["arrival_id"]), "rows")
        hashes = s.save(rows.filter("hash is not null").select("hash").distinct(), "hashes")
        old = s.save(self.near(hashes).withColumn("near", F.lit(True)), "near")
        keys = s.save(rows.filter(keyed).select("author_id", "created_at").distinct(), "keys")
        seen = s.save(self.known(keys).withColumn("known", F.lit(True)), "known")
        state = s.save(skew_join(rows, old, ["hash"], "left", unique=True), "hashed")
        state = skew_join(state, seen, ["author_id", "created_at"], "left", unique=True)
        repeats = F.coalesce("near", F.lit(False)) | F.coalesce("known", F.lit(False))
        state = s.save(state.select("arrival_id", "hash", "author_id", "created_at", repeats.alias("repeats")), "settled")
        s.drop("near", "hashed", "hashes", "keys", "known")
        done = [state.filter("repeats").select("arrival_id", "repeats")]
        fresh = state.filter("not repeats").select("arrival_id", "hash", "author_id", "created_at", F.lit(False).alias("accepted"))

        new = s.save(fresh.filter("hash is not null").select("hash").distinct(), "fresh")
        plan = bands(self.limit, band_count(self.limit, new.count()))
        stored = s.save(cells(new, "hash", plan, False), "cells")
        links = skew_join(probes_for(s, new, plan, "probes"), stored, ["at"]).filter(hamming("probe", "hash") <= self.limit)
        links = s.save(links.select("probe", "hash").distinct(), "links")
        s.drop("probes", "cells", "fresh")

        open_, turn = s.save(fresh, "open"), 0
        first = [F.min(F.when(~F.col("accepted"), F.col("arrival_id"))).alias("u"), F.min(F.when(F.col("accepted"), F.col("arrival_id"))).alias("a")]
        while not open_.filter("not accepted").isEmpty():
            by_hash = open_.filter("hash is not null").groupBy("hash").agg(*first)
            around = skew_join(links, by_hash, ["hash"], unique=True).groupBy(F.col("probe").alias("hash")).agg(F.min("u").alias("u"), F.min("a").alias("a"))
            by_key = open_.filter(keyed).groupBy("author_id", "created_at").agg(*first)
            told = skew_join(open_, around, ["hash"], unique=True).unionByName(skew_join(open_, by_key, ["author_id", "created_at"], unique=True))
            told = told.groupBy("arrival_id").agg(F.min("u").alias("u"), F.min("a").alias("a"))
            step, me = open_.join(told, "arrival_id", "left"), F.col("arrival_id")
            hit = ~F.col("accepted") & F.coalesce(F.col("a") < me, F.lit(False))
            free = F.coalesce(F.col("a") > me, F.lit(True)) & F.coalesce(F.col("u") >= me, F.lit(True))
            step = step.select("arrival_id", "hash", "author_id", "created_at", (F.col("accepted") | free).alias("accepted"), hit.alias("repeats"))
            step = s.save(step, f"step-{turn}")
            done.append(step.filter("repeats").select("arrival_id", "repeats"))
            open_, turn = step.filter("not repeats").drop("repeats"), turn + 1
        found = open_.select("arrival_id", F.lit(False).alias("repeats"))
        for d in done:
            found = found.unionByName(d)
        return rows.join(found, "arrival_id")


def repeated_arrivals(history: DataFrame, arrivals: DataFrame, limit: int = 10, *, batch: str | None = None, path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(arrival_id) of the arrivals that repeat history or an earlier arrival that doesn't repeat anything itself.

    Both have phash, author_id and created_at; arrivals also arrival_id. See History.check. With a path, the history there
    is opened, history and the arrivals that don't repeat are appended to it; without one it is made for this call.
    `batch` names a column of arrivals, never decreasing with arrival_id, whose values are checked one after the other;
    without it all arrivals are one batch, which gives the same result in fewer steps. Empty tables and columns of nulls
    only are allowed and give no case.
    """
    s = scratch or Scratch(history.sparkSession, "history")
    pick = [valid_hash("phash").alias("hash"), F.col("author_id"), F.col("created_at")]
    past = History(s, limit, path)
    past.append(history.select(*pick))
    out = None
    for value in [r[0] for r in arrivals.select(batch).distinct().orderBy(batch).collect()] if batch else [None]:
        rows = arrivals.filter(F.col(batch).eqNullSafe(F.lit(value))) if batch else arrivals
        checked = past.check(rows.select("arrival_id", *pick))
        found = checked.filter("repeats").select("arrival_id")
        out = found if out is None else out.unionByName(found)
        if batch or path:
            past.append(checked.filter("not repeats"))
    return out if out is not None else arrivals.select("arrival_id").limit(0)
