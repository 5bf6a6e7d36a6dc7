"""Session, shared scratch tables and small helpers that every operator may use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mosaiq")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application; operators with Python functions call it.

    Executors needn't have it installed or on their path. Spark distributes the archive and adds it to workers' paths.
    """
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _SHIPPED or not root.is_dir():  # a package within an archive has been shipped
        return
    _SHIPPED.add(app)
    archive = Path(tempfile.mkdtemp(prefix="mosaiq-")) / "mosaiq.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder of this machine serves local sessions, as in tests. On a cluster executors
    would write to disks of their own there, so that it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
        atexit.register(_remove, spark, found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; a leftover folder does no harm
        pass


class Scratch:
    """Tables written to the shared folder and read again.

    This cuts lineage in iterative operators, survives the loss of executors, and gives Catalyst the true size of an
    intermediate, so that it broadcasts only what is below its own threshold. Tables that no step drops stay until
    close(), the end of a `with` block, or the end of the driver: results that read them must be used before that. An
    operator takes a Scratch of the caller's as `scratch`, so that the caller decides when.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def part(self, label: str) -> Scratch:
        """A scratch below this one, for an operator that uses another; it goes with this one."""
        other = object.__new__(Scratch)
        other.spark, other.root = self.spark, f"{self.root}/{label}-{uuid.uuid4().hex}"
        return other

    def close(self) -> None:
        _remove(self.spark, self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def dense_ids(scratch: Scratch, keys: DataFrame, order: list, name: str, id_col: str = "n") -> DataFrame:
    """Adds to distinct rows the numbers 0, 1, 2... in the given order, without a single-partition sort.

    Rows are range-partitioned and sorted; a row's number is the count of the partitions before (one number each is
    brought to the driver) plus its place in its own.
    """
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.save(placed, name)
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, total = [], 0
    for p, c in sizes:
        offsets.append((p, total))
        total += c
    if len(offsets) < 2:
        return placed.withColumn(id_col, F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    starts = keys.sparkSession.createDataFrame(offsets, "_p long, _start long")
    numbered = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return numbered.withColumn(id_col, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_start")
