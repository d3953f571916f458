"""Manifest: counters, live files, versions, duplicates, orphans, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import errors as E

COUNTERS = ("next_file_id", "last_sequence", "log_number")


def counters(edits: DataFrame) -> DataFrame:
    """Each counter as the last edit that sets it leaves it (the last, not the largest)."""
    return edits.agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("edit_idx"))).alias(c) for c in COUNTERS])


def live_files(added: DataFrame, deleted: DataFrame, upto: int | None = None) -> DataFrame:
    """Files added and not deleted by a later edit. Deletes of an edit come before its adds; unknown ones are ignored."""
    if upto is not None:
        added, deleted = added.where(F.col("edit_idx") <= upto), deleted.where(F.col("edit_idx") <= upto)
    gone = deleted.groupBy("level", "file_id").agg(F.max("edit_idx").alias("gone_at"))
    return added.join(gone, (added["level"] == gone["level"]) & (added["file_id"] == gone["file_id"]) & (gone["gone_at"] > added["edit_idx"]), "left_anti")


def version(live: DataFrame) -> DataFrame:
    """Live files in reading order: level 0 as inserted, deeper levels by smallest key."""
    per = Window.partitionBy("level").orderBy(F.when(F.col("level") > 0, F.col("smallest_key")), "edit_idx", "file_id")
    return live.withColumn("ordinal", F.row_number().over(per))


def level_count(live: DataFrame) -> DataFrame:
    """Levels, empty ones below the deepest included."""
    return live.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("levels"))


def level_summary(live: DataFrame) -> DataFrame:
    return live.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("file_bytes").alias("bytes"))


def duplicate_adds(added: DataFrame, deleted: DataFrame) -> DataFrame:
    """``file_id, edit_idx`` of adds of a file that is live at that time; adds of an edit come before its deletes."""
    steps = added.select("file_id", "edit_idx", F.lit(0).alias("step"), F.lit(1).alias("d")).unionByName(deleted.select("file_id", "edit_idx", F.lit(1).alias("step"), F.lit(-1).alias("d")))
    w = Window.partitionBy("file_id").orderBy("edit_idx", "step")
    marked = steps.withColumn("before", F.lag("d").over(w))
    return marked.where("d = 1 and before = 1").select("file_id", "edit_idx")


def check_replay(edits: DataFrame, added: DataFrame, deleted: DataFrame) -> dict:
    """Counters of a whole manifest; raises for duplicates and a missing file counter."""
    twice = duplicate_adds(added, deleted).first()
    if twice:
        raise E.DuplicateFileError(f"file {twice['file_id']} in edit {twice['edit_idx']}")
    found = counters(edits).first().asDict()
    if found["next_file_id"] is None:
        raise E.CorruptManifestError("no next file id")
    return found


def file_name(file_id: Column) -> Column:
    return F.format_string("%020d.sst", file_id)


def parse_file_name(name: Column) -> Column:
    """File id of a canonical name, else null."""
    digits = F.regexp_extract(name, r"^(\d{20})\.sst$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def manifest_name(number: int) -> str:
    return f"MANIFEST-{number:06d}"


def next_manifest_id(listing: DataFrame) -> DataFrame:
    digits = F.regexp_extract("name", r"^MANIFEST-(\d+)$", 1)
    return listing.agg((F.coalesce(F.max(F.when(digits != "", digits.try_cast("bigint"))), F.lit(0)) + 1).alias("next_id"))


def check_pointer_name(name: str) -> str:
    name = name.strip()
    if not name or "/" in name or "\\" in name:
        raise E.PointerNameError(repr(name))
    return name


def orphans(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Canonical run files that no live file refers to; other names are none of ours."""
    ids = listing.withColumn("file_id", parse_file_name(F.col("name"))).where("file_id is not null")
    return ids.join(live.select("file_id"), "file_id", "left_anti").select("name", "file_id")


def missing(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Live files that are not there."""
    there = listing.select(parse_file_name(F.col("name")).alias("file_id")).where("file_id is not null")
    return live.join(there, "file_id", "left_anti")
