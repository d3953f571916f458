"""Read operators: winners, snapshots, point and range reads, scans over several sources.

Winners are chosen by an aggregate, combined before the shuffle; tombstones are dropped only
after that, for a tombstone hides what is older.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schema as S

#: Keys of a list up to which it is broadcast; ranges of keys by which a longer one is met.
SHORT_LIST, SEEK_RANGES = 10_000, 200


def winners(log: DataFrame, snapshot: int | None = None, order: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Newest version of every key, tombstones included: ``user_key, kind, value, seqno`` and ``carry``."""
    if snapshot is not None:
        log = log.where(F.col("seqno") <= snapshot)
    row = F.struct("kind", "value", "seqno", *carry)
    return log.groupBy("user_key").agg(F.max_by(row, F.col("seqno") if order is None else order).alias("w")).select("user_key", "w.*")


def latest(log: DataFrame, snapshot: int | None = None, order: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Live keys and their values at a snapshot (default: now)."""
    return winners(log, snapshot, order, carry).where(F.col("kind") == S.PUT).drop("kind")


def tombstones(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return winners(log, snapshot).where(F.col("kind") == S.DELETE).select("user_key", "seqno")


def by_source() -> Column:
    """Order of versions when several sources hold a key: the newer source, then the newer version."""
    return F.struct("source_rank", "seqno")


def by_insertion() -> Column:
    """Order when a (key, seqno) may repeat: the later insertion wins."""
    return F.struct("seqno", "insert_ord")


def status_of(kind: Column) -> Column:
    return F.when(kind.isNull(), "absent").when(kind == S.DELETE, "deleted").otherwise("found")


def get_many(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``user_key, status, value`` for each wanted key. The keys reduce the log before it is aggregated."""
    wanted = keys.select("user_key").distinct()
    found = winners(log.join(wanted, "user_key", "left_semi"), snapshot)
    return wanted.join(found, "user_key", "left").select("user_key", status_of(F.col("kind")).alias("status"), "value")


def get_as_of(log: DataFrame, requests: DataFrame, order: tuple[str, ...] = ("seqno",)) -> DataFrame:
    """``user_key, snapshot, status, value, seqno`` for each (key, snapshot) request: the newest version at or below it.

    One pass: requests and versions of a key are ordered together and the last version is
    carried forward, so a key with many versions and requests does not multiply them.
    """
    versions = log.select("user_key", F.col("seqno").alias("at"), F.lit(0).alias("asked"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"), F.struct("kind", "value", "seqno").alias("v"))
    asked = requests.select("user_key", F.col("snapshot").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast(versions.schema["o"].dataType).alias("o"), F.lit(None).cast(versions.schema["v"].dataType).alias("v"))
    w = Window.partitionBy("user_key").orderBy("at", "asked", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = versions.unionByName(asked).withColumn("last", F.last("v", ignorenulls=True).over(w)).where("asked = 1")
    return seen.select("user_key", F.col("at").alias("snapshot"), status_of(F.col("last.kind")).alias("status"), F.col("last.value").alias("value"), F.col("last.seqno").alias("seqno"))


def history(log: DataFrame, start: str | None = None) -> DataFrame:
    """All versions from a key on, with their place in the order of internal keys inside their key."""
    if start is not None:
        log = log.where(F.col("user_key") >= start)
    return log.withColumn("version_no", F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("seqno"))))


def seek(log: DataFrame, targets: DataFrame) -> DataFrame:
    """First entry at or after each target key: smallest key, newest version.

    A short list of targets is broadcast; a longer one is met in one ordered pass per range of keys.
    """
    heads = log.groupBy("user_key").agg(F.max_by(F.struct("seqno", "kind"), "seqno").alias("w"))
    few = targets.select("target").distinct()
    if few.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        hit = heads.join(F.broadcast(few), F.col("user_key") >= F.col("target")).groupBy("target").agg(F.min(F.struct("user_key", "w")).alias("m"))
    else:
        hit = _seek_ordered(heads, few)
    return few.join(hit, "target", "left").select("target", "m.user_key", "m.w.seqno", "m.w.kind")


def _seek_ordered(heads: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, m`` for any number of targets: the next head is carried backwards inside ranges of keys, then across them."""
    asked = targets.where("target is not null")
    cuts = sorted((r["target"] for r in asked.orderBy(F.xxhash64("target"), "target").limit(SEEK_RANGES).collect()), key=lambda k: k.encode())
    at_or_below = lambda key: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= key))
    m = F.struct("user_key", "w")
    entries = heads.where("user_key is not null").select(at_or_below(F.col("user_key")).alias("part"), F.col("user_key").alias("key"), F.lit(0).alias("asked"), m.alias("m"))
    wanted = asked.select(at_or_below(F.col("target")).alias("part"), F.col("target").alias("key"), F.lit(1).alias("asked"), F.lit(None).cast(entries.schema["m"].dataType).alias("m"))
    back = Window.partitionBy("part").orderBy(F.desc("key"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = entries.unionByName(wanted).withColumn("near", F.last("m", ignorenulls=True).over(back)).where("asked = 1")
    firsts = entries.groupBy("part").agg(F.min("m").alias("first"))  # one row a range
    later = asked.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("from")).join(F.broadcast(firsts), F.col("part") > F.col("from")).groupBy(F.col("from").alias("part")).agg(F.min("first").alias("later"))
    return seen.join(F.broadcast(later), "part", "left").select(F.col("key").alias("target"), F.coalesce("near", "later").alias("m"))


def scan_range(log: DataFrame, start: str | None = None, end: str | None = None, snapshot: int | None = None, limit: int | None = None) -> DataFrame:
    """Live keys of [start, end) in order. Bounds and snapshot reach the scan."""
    if start is not None:
        log = log.where(F.col("user_key") >= start)
    if end is not None:
        log = log.where(F.col("user_key") < end)
    out = latest(log, snapshot).orderBy("user_key")
    return out if limit is None else out.limit(limit)


def scan_reverse(log: DataFrame, start: str | None = None, end: str | None = None, snapshot: int | None = None, limit: int | None = None) -> DataFrame:
    """Live keys of [start, end) from the last to the first; a limit keeps the last ones."""
    out = scan_range(log, start, end, snapshot).orderBy(F.desc("user_key"))
    return out if limit is None else out.limit(limit)


def scan_prefix(log: DataFrame, prefix: str, snapshot: int | None = None) -> DataFrame:
    return latest(log.where(F.col("user_key").startswith(prefix)), snapshot)


def resurrected(log: DataFrame) -> DataFrame:
    """Puts whose previous version is a tombstone."""
    w = Window.partitionBy("user_key").orderBy("seqno")
    return log.withColumn("before", F.lag("kind").over(w)).where((F.col("kind") == S.PUT) & (F.col("before") == S.DELETE)).select("user_key", "seqno")


def source_hits(log: DataFrame) -> DataFrame:
    """For each key the source that answers a read and how many sources are asked until then."""
    newest = log.agg(F.max("source_rank")).first()[0] or 0
    hit = log.groupBy("user_key").agg(F.max_by(F.struct("source", "source_rank"), by_source()).alias("w"))
    return hit.select("user_key", "w.source", (F.lit(newest) - F.col("w.source_rank") + 1).cast("bigint").alias("probed"))


def read_amplification(runs: DataFrame) -> DataFrame:
    """Runs that hold each key, and its versions."""
    per = runs.groupBy("user_key", "sst_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_key").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("versions"))
