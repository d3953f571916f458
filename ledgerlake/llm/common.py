"""Shared pieces: staged tables in the shared folder, batches, column names and connected components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch handed to Python: whole texts can be long, so batches stay small.
BATCH_ROWS = 128
#: Bytes of a table, as rows of integers, up to which it is broadcast.
BROADCAST_BYTES = 8_000_000
#: Seconds from one collection of the driver's garbage to the next, at least.
COLLECT_SECONDS = 4.0
_collected = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent a local folder is chosen and set, but only if driver and
    executors are one process, as in tests; on a cluster its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, batches handed to Python hold at most so many rows; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """For a frame that is returned before it runs: from now on batches of the session hold at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def staged(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    Python functions in ``df`` get batches of at most ``rows``. What was shuffled for the table is
    garbage from now on; Spark deletes shuffle files only when the driver collects its
    garbage, so that is asked for here now and then, or the files of all steps would add up.
    """
    global _collected
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if time.monotonic() - _collected > COLLECT_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``staged`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def maybe_broadcast(df: DataFrame, row_bytes: int = 16, rows: int | None = None) -> DataFrame:
    """Broadcast a staged table of integers if it is short; else leave it to a shuffle. ``rows``: their number, if known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores after it a name that no column of ``frames`` has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: columns ``a`` and ``b`` (bigint). Returns ``node, root`` for every node that has
    an edge to another one; ``root`` is the smallest node of its component. Each round is a few
    shuffles of the edge table with minima combined before the shuffle; no group is gathered.
    """
    cut = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        both = cut.select("u", "v").unionByName(cut.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = staged(small, "edges")
        # Done if every node has one parent at most and no parent has one.
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(new.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        done = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
        discard(cut)
        cut = new
        if done:
            break
    roots = cut.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cut.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
