"""The store: versions of keys in Parquet runs, a log of batches, a manifest, a pointer.

Files go through Spark's readers and writers and the Hadoop file system, so any store that
Spark reaches will do. A commit is: data first, then the manifest row that names it, then the
swap of the pointer. Readers resolve the pointer once and see that version only.

Unlike an engine that replays its whole log on every open, operations that durable runs hold
are not replayed: the log is a folder of segments, named by their first sequence number, and those
that a committed run holds are deleted.

One writer at a time: a store that is opened for writing puts its name into WRITER. One that was
open before finds another name there, and its next append or commit raises FencedError instead
of touching what is no longer its own; so the new writer may delete runs that no manifest names.
Stores opened with ``read_only`` neither fence nor delete anything, and see what is committed.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.operators import changelog, manifest, reads, runs
from ledgerlake.sources import framed

LOG = "user_key binary, seqno bigint, kind int, value binary, source_rank bigint"
EDITS = "edit_idx bigint, next_file_id bigint, last_sequence bigint, level int, file_id bigint, entries bigint, bytes bigint, smallest_key binary, largest_key binary, deleted array<bigint>"
#: Places where a test may stop the store, in the order in which a write and then a flush pass them.
POINTS = ("log_append", "log_appended", "log_synced", "run_write", "run_written", "run_publish", "edit_written", "pointer_swapped")


def _alone(method):
    """One thread at a time inside the store: writers wait while another one flushes."""

    @functools.wraps(method)
    def call(self, *args, **kwargs):
        with self._lock:
            return method(self, *args, **kwargs)

    return call


@dataclass(frozen=True)
class Options:
    """``flush_bytes``: bytes of unflushed operations that start a flush, 0 for never; ``block_bytes``: target of a block, 0 for the default."""

    flush_bytes: int = 0
    block_bytes: int = 0

    def __post_init__(self):
        if self.flush_bytes < 0 or self.block_bytes < 0:
            raise E.InvalidOptionError("sizes must not be negative")

    @property
    def block_target(self) -> int:
        return self.block_bytes or S.DEFAULT_BLOCK_BYTES


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options(), hook: Callable[[str], None] | None = None, read_only: bool = False):
        self.spark, self.path, self.options, self.read_only = spark, path.rstrip("/"), options, read_only
        self._name, self._snapshots, self._lock = uuid.uuid4().hex, [], threading.RLock()
        self._hook = hook or (lambda point: None)
        self._closed, self._failure = False, None
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not read_only:
            self._fs.mkdirs(self._at(""))
            self._replace("WRITER", self._name)
        if not self._exists("CURRENT") and not read_only:
            self._commit([], 0, 1)
        self._resolve()
        absent = [r["file_id"] for r in self.live().select("file_id").collect() if not self._exists(f"runs/{r['file_id']:020d}.sst")]
        if absent:
            raise E.MissingFileError(f"runs {absent[:5]}")
        if not read_only:
            self._remove_orphans()
            self._trim()
        self.seqno = self.memtable().agg(F.max("seqno")).first()[0] or self.flushed

    def _resolve(self) -> None:
        """Counters of the version that the pointer names."""
        name = self._current()
        if not self._exists(name):
            raise E.MissingFileError(name)
        state = self.edits().agg(F.max_by("next_file_id", "edit_idx").alias("n"), F.max_by("last_sequence", "edit_idx").alias("s")).first()
        if state["n"] is None:
            raise E.CorruptManifestError("no next file id")
        self._next_file, self.flushed = state["n"], state["s"] or 0

    # --- files ---------------------------------------------------------------------------

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def _current(self) -> str:
        if not self._exists("CURRENT"):
            raise E.NoPointerError(self.path)
        return manifest.check_pointer_name(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def _owned(self) -> None:
        """Raises unless this store is the last one that was opened for writing."""
        if self.read_only:
            raise E.ReadOnlyError(self.path)
        if self.spark.read.text(f"{self.path}/WRITER", wholetext=True).first()[0].strip() != self._name:
            raise E.FencedError("another writer has opened the store")

    def _replace(self, target: str, name: str) -> None:
        """A file with one name in it, renamed over the old one."""
        framed.replace_text(self.spark, f"{self.path}/{target}", name + "\n")

    def _commit(self, rows: list[tuple], sequence: int, next_file: int) -> None:
        """Write a manifest with one more edit and point at it."""
        old = self.edits() if self._exists("CURRENT") else self.spark.createDataFrame([], EDITS)
        number = (old.agg(F.max("edit_idx")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(number, next_file, sequence, *r) for r in rows] or [(number, next_file, sequence, *[None] * 7)], EDITS)
        name = f"{manifest.manifest_name(number)}-{uuid.uuid4().hex}"
        old.unionByName(new).coalesce(1).write.parquet(f"{self.path}/{name}")
        self._hook("edit_written")
        self._owned()
        self._replace("CURRENT", name)
        self._hook("pointer_swapped")

    def _remove_orphans(self) -> None:
        """Run folders that the version does not name: what a commit that did not finish left."""
        if not self._exists("runs"):
            return
        live = {f"{r['file_id']:020d}.sst" for r in self.live().select("file_id").collect()}
        for status in self._fs.listStatus(self._at("runs")):
            name = status.getPath().getName()
            if len(name) == 24 and name.endswith(".sst") and name[:20].isdigit() and name not in live:
                self._fs.delete(status.getPath(), True)

    # --- state ---------------------------------------------------------------------------

    def _open(self) -> None:
        if self._closed:
            raise E.ClosedError("the store is closed")

    def edits(self) -> DataFrame:
        return self.spark.read.schema(EDITS).parquet(f"{self.path}/{self._current()}")

    def live(self, upto: int | None = None) -> DataFrame:
        """Live files now or after an earlier edit."""
        e = self.edits()
        added = e.where("file_id is not null").select("edit_idx", "level", "file_id", "entries", "bytes", "smallest_key", "largest_key")
        deleted = e.where("deleted is not null").select("edit_idx", F.explode("deleted").alias("file_id")).withColumn("level", F.lit(0))
        return manifest.live_files(added, deleted, upto)

    def segments(self) -> list[tuple[int, str]]:
        """First sequence number and folder of the log's complete segments."""
        if not self._exists("log"):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("log"))]
        return sorted((int(n[:20]), n) for n in names if n[:20].isdigit() and self._exists(f"log/{n}/_SUCCESS"))

    def _trim(self) -> None:
        """Delete segments whose operations a committed run holds; micro-batches among them stay marked as done."""
        for first, name in self.segments():
            if first <= self.flushed:
                parts = name.split("-")  # first number, own name and, of a micro-batch, its number
                if len(parts) == 3:
                    self._mark(int(parts[2][1:]))
                self._fs.delete(self._at(f"log/{name}"), True)

    def memtable(self) -> DataFrame:
        """Operations that no durable run holds yet; they outrank every run."""
        if self.read_only:
            self._resolve()
        held = [f"{self.path}/log/{name}" for first, name in self.segments() if first > self.flushed]
        if not held:
            return self.spark.createDataFrame([], LOG)
        log = self.spark.read.schema("user_key binary, seqno bigint, kind int, value binary").parquet(*held)
        return log.where(F.col("seqno") > self.flushed).withColumn("source_rank", F.lit(2**62))

    def versions(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions, of [low, high] if given: runs whose key range lies outside are not opened."""
        files = self.live()
        if low is not None:
            files = files.where(F.col("largest_key") >= F.lit(bytearray(low)))
        if high is not None:
            files = files.where(F.col("smallest_key") <= F.lit(bytearray(high)))
        log = self.memtable()
        ids = [r["file_id"] for r in files.select("file_id").collect()]
        if ids:
            at = self.spark.read.schema(LOG).parquet(*[f"{self.path}/runs/{i:020d}.sst" for i in ids])
            log = log.unionByName(at)
        if low is not None:
            log = log.where(F.col("user_key") >= F.lit(bytearray(low)))
        if high is not None:
            log = log.where(F.col("user_key") <= F.lit(bytearray(high)))
        return log

    # --- writes --------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> int:
        return self.write([(S.PUT, key, value)])

    def delete(self, key: bytes) -> int:
        return self.write([(S.DELETE, key, None)])

    @_alone
    def write(self, ops: changelog.Batch | list[tuple[int, bytes, bytes | None]] | None, cancelled: bool = False) -> int:
        """One atomic batch; returns the last sequence number. Nothing to do takes none."""
        self._ready(cancelled)
        ops = ops.ops if isinstance(ops, changelog.Batch) else ops
        if not ops:
            return self.seqno
        if any(t not in (S.PUT, S.DELETE) for t, _, _ in ops):
            raise E.UnknownOpError("kind")
        rows = [(bytearray(k), self.seqno + i + 1, t, bytearray(v or b"") if t == S.PUT else None) for i, (t, k, v) in enumerate(ops)]
        return self._append(self.spark.createDataFrame(rows, "user_key binary, seqno bigint, kind int, value binary").coalesce(1), len(rows))

    def _ready(self, cancelled: bool = False) -> None:
        """What must hold before any write, in this order."""
        self._open()
        if self.read_only:
            raise E.ReadOnlyError(self.path)
        if self._failure:
            raise E.FlushFailedError(str(self._failure))
        if cancelled:
            raise E.CancelledError("before the append")

    @_alone
    def ingest(self, batches: DataFrame, micro_batch: int | None = None, cancelled: bool = False) -> int:
        """A whole frame ``batch_id, ops`` as one append; operations are numbered in order.

        A ``micro_batch`` number that was appended before is skipped, also if the store was
        stopped right after the append: the number is part of the segment's name.
        """
        self._ready(cancelled)
        if micro_batch is not None and (self._exists(f"stream-commits/{micro_batch:020d}") or any(n.endswith(f"-b{micro_batch}") for _, n in self.segments())):
            return self.seqno
        known = lambda op: op["op_type"].isNotNull() & op["op_type"].isin(S.PUT, S.DELETE)
        facts = batches.select(F.sum(F.size("ops")).alias("n"), F.max(~F.forall("ops", known)).alias("bad")).first()
        if facts["bad"]:
            raise E.UnknownOpError("kind")
        log = changelog.explode_batches(batches, self.seqno).select("user_key", "seqno", "kind", "value")
        return self._append(log, facts["n"] or 0, micro_batch)

    def _mark(self, micro_batch: int) -> None:
        self._fs.mkdirs(self._at("stream-commits"))
        self._fs.create(self._at(f"stream-commits/{micro_batch:020d}")).close()

    def _append(self, log: DataFrame, count: int, micro_batch: int | None = None) -> int:
        if count:
            self._owned()
            self._hook("log_append")
            log.write.parquet(f"{self.path}/log/{self.seqno + 1:020d}-{uuid.uuid4().hex}" + ("" if micro_batch is None else f"-b{micro_batch}"))
            self._hook("log_appended")
            self._hook("log_synced")  # a segment is durable once it is complete, so both are one place
            self.seqno += count
        if micro_batch is not None:
            self._mark(micro_batch)
        if count and self.options.flush_bytes:
            used = self.memtable().agg(F.sum(runs.memtable_entry())).first()[0] or 0
            if used >= self.options.flush_bytes:
                self.flush()
        return self.seqno

    @_alone
    def flush(self) -> int | None:
        """Write the unflushed operations as one sorted run; returns its id, or None if there are none."""
        self._ready()
        try:
            self._owned()
            mem = self.memtable().drop("source_rank")
            facts = mem.agg(F.count(F.lit(1)).alias("n"), F.sum(runs.entry_size()).alias("b"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi"), F.max("seqno").alias("s")).first()
            if not facts["n"]:
                return None
            number = self._next_file
            self._hook("run_write")
            self._write_run(mem, number)
            self._hook("run_written")
            self._hook("run_publish")
            self._commit([(0, number, facts["n"], facts["b"], facts["lo"], facts["hi"], None)], facts["s"], number + 1)
        except Exception as e:
            self._failure = e
            raise
        self._next_file, self.flushed = number + 1, facts["s"]
        self._trim()
        return number

    def _write_run(self, log: DataFrame, number: int) -> None:
        ordered = log.withColumn("source_rank", F.lit(number).cast("bigint")).repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seqno"))
        ordered.write.mode("overwrite").parquet(f"{self.path}/runs/{number:020d}.sst")

    @_alone
    def compact(self, snapshots: tuple[int, ...] = ()) -> int | None:
        """Merge all live runs into one; versions that open snapshots of this store, or those given, need stay."""
        self._ready()
        self._owned()
        snapshots = tuple(sorted({*snapshots, *self._snapshots}))
        ids = [r["file_id"] for r in self.live().select("file_id").collect()]
        if not ids:
            return None
        merged = runs.compact(self.spark.read.schema(LOG).parquet(*[f"{self.path}/runs/{i:020d}.sst" for i in ids]), snapshots=snapshots)
        number = self._next_file
        self._write_run(merged.select("user_key", "seqno", "kind", "value"), number)
        self._hook("run_written")
        facts = self.spark.read.schema(LOG).parquet(f"{self.path}/runs/{number:020d}.sst").agg(F.count(F.lit(1)).alias("n"), F.sum(runs.entry_size()).alias("b"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi")).first()
        self._commit([(0, number, facts["n"], facts["b"], facts["lo"], facts["hi"], ids)], self.flushed, number + 1)
        self._next_file = number + 1
        return number

    # --- reads ---------------------------------------------------------------------------

    def snapshot(self) -> int:
        """A sequence number that reads may ask for; compaction keeps its versions until it is released."""
        self._open()
        self._snapshots.append(self.seqno)
        return self.seqno

    def release(self, snapshot: int) -> None:
        self._snapshots.remove(snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes:
        self._open()
        hit = reads.winners(self.versions(key, key), snapshot, reads.by_source()).first()
        if hit is None or hit["kind"] == S.DELETE:
            raise E.KeyNotFoundError(repr(key))
        return bytes(hit["value"])

    def get_many(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        self._open()
        return reads.get_many(self.versions(), keys, snapshot)

    def scan(self, start: bytes | None = None, end: bytes | None = None, snapshot: int | None = None, limit: int | None = None) -> DataFrame:
        """Live keys of [start, end) in order."""
        self._open()
        log = self.versions(start, end)
        if end is not None:
            log = log.where(F.col("user_key") < F.lit(bytearray(end)))
        out = reads.latest(log, snapshot, reads.by_source()).orderBy("user_key")
        return out if limit is None else out.limit(limit)

    def stats(self) -> DataFrame:
        """Blocks, entries and sizes of each live run under the block target."""
        self._open()
        ids = self.versions().where(F.col("source_rank") < 2**62).withColumn("user_key", F.col("user_key").cast("string")).withColumn("value", F.col("value").cast("string"))
        return runs.footers(runs.blocks(runs.pack(ids.withColumnRenamed("source_rank", "sst_id"), self.options.block_target)))

    @_alone
    def close(self) -> None:
        """No flush: what is in the log is found again on opening."""
        self._open()
        self._closed = True


