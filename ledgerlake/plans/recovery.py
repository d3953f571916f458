"""Opening a folder of binary files: pointer, manifest, runs and log segments become one changelog.

``CURRENT`` names the manifest; runs are ``%020d.sst``, log segments ``%020d.wal``, named by the first
sequence number in them. What a crash leaves is put in order: a torn last record of the manifest or
of the newest segment is cut off, runs that no edit names are deleted. Any other damage raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.functions import codecs
from ledgerlake.operators import manifest, records
from ledgerlake.sources import files, framed

IN_MEMORY = 2**62


@dataclass(frozen=True)
class Recovered:
    """``counters`` of the manifest, its ``live`` files, all ``versions`` with their source, and what was put in order."""

    counters: dict
    live: DataFrame
    versions: DataFrame
    orphans: list[str]
    torn: list[str]


def split_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added and deleted files of edits, one row each."""
    added = edits.select("edit_idx", F.explode("added").alias("f")).select(
        "edit_idx", "f.level", "f.file_id", F.col("f.size").alias("file_bytes"),
        F.col("f.smallest.user_key").alias("smallest_key"), F.col("f.smallest.seqno").alias("smallest_seqno"),
        F.col("f.largest.user_key").alias("largest_key"), F.col("f.largest.seqno").alias("largest_seqno"),
    )
    deleted = edits.select("edit_idx", F.explode("deleted").alias("f")).select("edit_idx", "f.level", "f.file_id")
    return added, deleted


def replay_log(segments: DataFrame, flushed: int = 0) -> DataFrame:
    """Operations of valid records (``path, pos, payload, status``) above ``flushed``, numbered from their segment's first number.

    A segment is numbered in one task; segments side by side.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(path, pos, i, key, kind, (value or b"") if kind == S.PUT else None) for path, pos, data in pdf.itertuples(index=False) for i, (kind, key, value) in enumerate(codecs.decode_batch(bytes(data)))]
            yield pd.DataFrame(rows, columns=["path", "pos", "op_idx", "user_key", "kind", "value"])

    ops = segments.where("status = 'ok'").select("path", "pos", "payload").mapInPandas(run, "path string, pos bigint, op_idx bigint, user_key binary, kind int, value binary")
    first = F.regexp_extract("path", r"(\d{20})\.wal$", 1).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("path").orderBy("pos", "op_idx"))
    return ops.select("user_key", (first + inside - 1).alias("seqno"), "kind", "value").where(F.col("seqno") > flushed)


def read_manifest(spark: SparkSession, path: str, repair: bool = True) -> tuple[DataFrame, bool]:
    """Edits of a framed manifest and whether its last record was torn; other damage raises."""
    found = files.read_log(spark, path, S.MANIFEST_MAGIC)
    try:
        torn = records.check_tail(found) == "torn"
    except E.CorruptLogError as e:
        raise E.CorruptManifestError(str(e)) from e
    if torn and repair:
        framed.repair_log(spark, path, S.MANIFEST_MAGIC)
        found = files.read_log(spark, path, S.MANIFEST_MAGIC)
    return files.read_edits(found), torn


def recover(spark: SparkSession, folder: str, repair: bool = True) -> Recovered:
    """Bring a folder back after a crash; with ``repair`` false nothing is cut or deleted."""
    system, at = framed._hadoop(spark, folder)
    names = sorted(x.getPath().getName() for x in system.listStatus(at))
    if "CURRENT" not in names:
        raise E.NoPointerError(folder)
    name = manifest.check_pointer_name(spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0])
    if name not in names:
        raise E.MissingFileError(name)
    edits, torn = read_manifest(spark, f"{folder}/{name}", repair)
    cut = [name] if torn else []
    added, deleted = split_edits(edits)
    counters = manifest.check_replay(edits, added, deleted)
    live = manifest.live_files(added, deleted)
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    absent = manifest.missing(listing, live).first()
    if absent:
        raise E.MissingFileError(manifest_file(absent["file_id"]))
    orphans = [r["name"] for r in manifest.orphans(listing, live).orderBy("name").collect()]
    if repair:
        for orphan in orphans:
            system.delete(framed._hadoop(spark, f"{folder}/{orphan}")[1], False)

    held = live.select(F.col("file_id").alias("sst_id"), F.concat(F.lit(folder.rstrip("/") + "/"), manifest.file_name(F.col("file_id"))).alias("path"))
    versions = framed.read_entries(held).select("user_key", "seqno", "kind", "value", F.col("sst_id").alias("source_rank"))
    segments = [n for n in names if len(n) == 24 and n.endswith(".wal") and n[:20].isdigit()]
    for i, segment in enumerate(segments):
        tail = records.check_tail(files.read_log(spark, f"{folder}/{segment}"))
        if tail == "torn" and i + 1 < len(segments):
            raise E.CorruptLogError(f"{segment} is torn, and others follow")
        if tail == "torn":
            cut.append(segment)
            if repair:
                framed.repair_log(spark, f"{folder}/{segment}")
    if segments:
        log = replay_log(files.read_log(spark, [f"{folder}/{n}" for n in segments]), counters["last_sequence"] or 0)
        versions = versions.unionByName(log.withColumn("source_rank", F.lit(IN_MEMORY)))
    return Recovered(counters, live, versions, orphans, cut)


def manifest_file(file_id: int) -> str:
    return f"{file_id:020d}.sst"
