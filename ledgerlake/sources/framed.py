"""Run files and framed logs, written piece by piece and read in ranges.

Run files are reached through ``pyarrow.fs`` on the driver and on executors alike, so their paths
need a scheme that pyarrow knows (file, hdfs, s3, gs). Logs are written by one driver through
the Hadoop file system, whose streams can be made durable record by record.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.functions import codecs
from ledgerlake.operators import records, runs
from ledgerlake.sources import files

FILES = "sst_id bigint, path string, bytes bigint, entries bigint, smallest_key binary, smallest_seqno bigint, largest_key binary, largest_seqno bigint, max_seqno bigint"
ENTRIES = "sst_id bigint, position bigint, user_key binary, seqno bigint, kind int, value binary"
NEWEST = 2**64 - 1
#: Rows of one output batch when whole runs are read.
BATCH_ROWS = 4096


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


# --- reading one run -----------------------------------------------------------------------


class RunReader:
    """One run file. Opening reads footer and index; a block is read when it is asked for, and the last one is kept."""

    def __init__(self, path: str):
        system, name = _place(path)
        self._file = system.open_input_file(name)
        size = self._file.size()
        if size < S.FOOTER:
            raise E.CorruptFooterError("file too small")
        self.index_offset, self.index_bytes, blocks, self.entry_count = codecs.decode_footer(self._read(size - S.FOOTER, S.FOOTER))
        if self.index_offset + self.index_bytes + S.FOOTER != size:
            raise E.CorruptFooterError("index does not end at the footer")
        self.index = codecs.decode_index(self._read(self.index_offset, self.index_bytes))
        ends = [offset + length for _, offset, length in self.index]
        if [0, *ends] != [*(offset for _, offset, _ in self.index), self.index_offset]:
            raise E.CorruptIndexError("blocks do not follow each other")
        if len(self.index) != blocks:
            raise E.CorruptFooterError("counts")
        self._last = [(key, -seqno) for (key, seqno, _), _, _ in self.index]
        self._held: tuple[int, list] = (-1, [])

    def _read(self, at: int, size: int) -> bytes:
        if self._file.closed:
            raise E.ClosedError("the run is closed")
        return self._file.read_at(size, at)

    def block(self, number: int) -> list[tuple[bytes, int, int, bytes | None]]:
        if self._file.closed:
            raise E.ClosedError("the run is closed")
        if self._held[0] != number:
            _, offset, size = self.index[number]
            self._held = number, codecs.decode_block(self._read(offset, size))
        return self._held[1]

    def place(self, key: bytes, seqno: int = NEWEST) -> tuple[int, int]:
        """Block and position of the first entry at or after (key, seqno); the block after the last if there is none."""
        number = bisect_left(self._last, (key, -seqno))
        if number == len(self.index):
            return number, 0
        return number, bisect_left([(k, -n) for k, n, _, _ in self.block(number)], (key, -seqno))

    def get(self, key: bytes, snapshot: int = NEWEST) -> tuple[int, int, bytes | None] | None:
        """``seqno, kind, value`` of the newest version at or below the snapshot, a tombstone too; one block is read."""
        number, at = self.place(key, snapshot)
        if number == len(self.index) or at == len(self.block(number)):
            return None
        found, seqno, kind, value = self.block(number)[at]
        return (seqno, kind, value) if found == key else None

    def cursor(self) -> "RunCursor":
        return RunCursor(self)

    def close(self) -> None:
        self._file.close()


class RunCursor:
    """All versions of a run in order. The end stops the iteration, damage raises, and after ``close`` every call raises."""

    def __init__(self, run: RunReader):
        self._run, self._at, self._closed = run, (0, 0), False

    def _open(self) -> None:
        if self._closed:
            raise E.IteratorClosedError("the cursor is closed")

    def seek(self, key: bytes, seqno: int = NEWEST) -> "RunCursor":
        """Go to the first entry at or after (key, seqno); forwards or backwards."""
        self._open()
        self._at = self._run.place(key, seqno)
        return self

    def __iter__(self) -> Iterator[tuple[bytes, int, int, bytes | None]]:
        return self

    def __next__(self) -> tuple[bytes, int, int, bytes | None]:
        self._open()
        number, at = self._at
        while number < len(self._run.index):
            block = self._run.block(number)
            if at < len(block):
                self._at = number, at + 1
                return block[at]
            number, at = number + 1, 0
        self._at = number, 0
        raise StopIteration

    def close(self) -> None:
        self._open()
        self._closed = True


# --- runs in parallel ----------------------------------------------------------------------


def run_path(folder: str, sst_id: int) -> str:
    return f"{folder.rstrip('/')}/{sst_id:020d}.sst"


class _RunFile:
    """A run file in the making, under a name of its own until it is whole."""

    def __init__(self, folder: str, sst_id: int, target: int):
        self._system, self._name = _place(run_path(folder, sst_id))
        self._system.create_dir(os.path.dirname(self._name), recursive=True)
        self._temporary = f"{self._name}.{uuid.uuid4().hex}"
        self._out = self._system.open_output_stream(self._temporary)
        self.sst_id, self._path, self._newest = sst_id, run_path(folder, sst_id), 0
        self._writer = codecs.RunWriter(self._out, target)

    def add(self, key: bytes, seqno: int, kind: int, value: bytes | None) -> None:
        self._writer.add(key, seqno, kind, value)
        self._newest = max(self._newest, seqno)

    def finish(self) -> tuple:
        size = self._writer.close()
        self._out.close()
        self._system.move(self._temporary, self._name)
        (lo, lo_seqno, _), (hi, hi_seqno, _) = self._writer.first, self._writer.last
        return self.sst_id, self._path, size, self._writer.entries, lo, lo_seqno, hi, hi_seqno, self._newest


def write_runs(log: DataFrame, folder: str, target: int = S.DEFAULT_BLOCK_BYTES) -> DataFrame:
    """One run file for each ``sst_id`` of a changelog; a row of facts a file, whose reading starts the writing.

    Runs are written side by side, each in order and block by block, so a task holds a block and an index.
    """
    names = [c.strip().split()[0] for c in FILES.split(",")]
    ordered = log.select("sst_id", F.col("user_key").cast("binary").alias("user_key"), "seqno", "kind", F.col("value").cast("binary").alias("value"))
    ordered = ordered.repartition("sst_id").sortWithinPartitions("sst_id", "user_key", F.desc("seqno"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []
        for pdf in frames:
            for sst_id, key, seqno, kind, value in pdf.itertuples(index=False):
                if now is None or now.sst_id != sst_id:
                    done += [now.finish()] if now else []
                    now = _RunFile(folder, int(sst_id), target)
                now.add(bytes(key), int(seqno), int(kind), bytes(value or b"") if kind == S.PUT else None)
        done += [now.finish()] if now else []
        yield pd.DataFrame(done, columns=names)

    return ordered.mapInPandas(run, FILES)


def get_from_runs(run_files: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``sst_id, user_key, seqno, kind, value``: the newest version at or below the snapshot that each run holds of each wanted key.

    Only runs whose key range holds a key are opened for it, and of those only the block that may have it.
    """
    at = NEWEST if snapshot is None else snapshot
    pairs = runs.prune(run_files, keys.select(F.col("user_key").cast("binary").alias("user_key"))).join(F.broadcast(run_files.select("sst_id", "path")), "sst_id")  # a row a run
    pairs = pairs.repartitionByRange("sst_id", "wanted").sortWithinPartitions("sst_id", "wanted").select("sst_id", "path", "wanted")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, name = None, None
        for pdf in frames:
            out = []
            for sst_id, path, key in pdf.itertuples(index=False):
                if path != name:
                    opened, name = RunReader(path), path
                hit = opened.get(bytes(key), at)
                if hit:
                    out.append((sst_id, bytes(key), *hit))
            yield pd.DataFrame(out, columns=["sst_id", "user_key", "seqno", "kind", "value"])

    return pairs.mapInPandas(run, "sst_id bigint, user_key binary, seqno bigint, kind int, value binary")


def read_entries(run_files: DataFrame, start: bytes | None = None) -> DataFrame:
    """All versions of runs (``sst_id, path``) from ``start`` on, block by block: ``sst_id, position, user_key, seqno, kind, value``."""
    names = [c.strip().split()[0] for c in ENTRIES.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for sst_id, path in pdf.itertuples(index=False):
                opened, rows = RunReader(path), []
                cursor = opened.cursor() if start is None else opened.cursor().seek(start)
                for position, entry in enumerate(cursor):
                    rows.append((sst_id, position, *entry))
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)
                opened.close()

    return run_files.select("sst_id", "path").repartition("sst_id").mapInPandas(run, ENTRIES)


def read_index(run_files: DataFrame) -> DataFrame:
    """One row a block, from footers and indexes alone: ``sst_id, entry_count, index_offset, index_bytes, block_idx, block_offset, block_bytes, last_key, last_seqno``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for sst_id, path in pdf.itertuples(index=False):
                r = RunReader(path)
                rows = [(sst_id, r.entry_count, r.index_offset, r.index_bytes, i, offset, size, key, seqno) for i, ((key, seqno, _), offset, size) in enumerate(r.index)]
                r.close()
                yield pd.DataFrame(rows, columns=["sst_id", "entry_count", "index_offset", "index_bytes", "block_idx", "block_offset", "block_bytes", "last_key", "last_seqno"])

    return run_files.select("sst_id", "path").repartition("sst_id").mapInPandas(run, "sst_id bigint, entry_count bigint, index_offset bigint, index_bytes bigint, block_idx bigint, block_offset bigint, block_bytes bigint, last_key binary, last_seqno bigint")


# --- logs ----------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def swap_in(spark: SparkSession, temporary: str, path: str) -> None:
    """Rename over what is there, in one step."""
    system, at = _hadoop(spark, path)
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(_hadoop(spark, temporary)[1]), system.makeQualified(at), kinds)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file whose readers see the old or the new text."""
    temporary = f"{path}-{uuid.uuid4().hex}"
    system, at = _hadoop(spark, temporary)
    out = system.create(at)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    swap_in(spark, temporary, path)


class LogWriter:
    """Framed records appended to a new file by one writer.

    ``append`` hands a record to the stream, ``sync`` makes all of them durable; ``sync_each`` does so
    for every record, as a manifest needs. After a failure every later call raises it again.
    A file that is there is never appended to: not every store can, and a new segment is as good.
    """

    def __init__(self, spark: SparkSession, path: str, magic: bytes = S.WAL_MAGIC, sync_each: bool = False):
        system, at = _hadoop(spark, path)
        self._out, self._magic, self._sync_each = system.create(at, False), magic, sync_each
        self.offset, self._failure, self._closed = 0, None, False

    def _try(self, call) -> None:
        if self._closed:
            raise E.ClosedError("the log is closed")
        if self._failure:
            raise self._failure
        try:
            call()
        except Exception as e:
            self._failure = e
            raise

    def append(self, payload: bytes) -> tuple[int, int]:
        """Offsets of the record's start and end."""
        record = codecs.encode_record(self._magic, payload)
        self._try(lambda: self._out.write(bytearray(record)))
        start, self.offset = self.offset, self.offset + len(record)
        if self._sync_each:
            self.sync()
        return start, self.offset

    def sync(self) -> None:
        self._try(self._out.hsync)

    def close(self) -> None:
        self._try(self._out.close)
        self._closed = True


def repair_log(spark: SparkSession, path: str, magic: bytes = S.WAL_MAGIC) -> int:
    """Cut a torn last record off a log file; returns the bytes that stay. Any other damage raises and changes nothing."""
    found = files.read_log(spark, path, magic)
    torn = records.check_tail(found) == "torn"
    kept = found.where("status = 'ok'").agg(F.max("end_offset")).first()[0] or 0
    if torn:
        system, at = _hadoop(spark, path)
        temporary = f"{path}-{uuid.uuid4().hex}"
        source, out = system.open(at), system.create(_hadoop(spark, temporary)[1])
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, kept)
        out.hsync()
        out.close()
        source.close()
        swap_in(spark, temporary, path)
    return kept
