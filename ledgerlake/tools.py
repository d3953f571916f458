"""Dump tools for files: ``python -m ledgerlake.tools log|run|manifest [--decode] [--entries] PATH``.

Exit codes: 0 for what was read to its end, torn tails and folders without a pointer included; 1 for
what cannot be read or is damaged, after all that comes before the damage is printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.operators import dumps, manifest
from ledgerlake.plans import recovery
from ledgerlake.sources import files, framed


def dump_log(spark: SparkSession, path: str, decode: bool = False) -> int:
    found = dumps.log_records(files.read_log(spark, path), decode)
    for r in found.orderBy("pos").toLocalIterator():
        if r["status"] != "ok":
            print(f"record {r['pos']}: {r['status']}")
        else:
            more = f", {r['error'] or str(r['op_count']) + ' operations'}" if decode else ""
            print(f"record {r['pos']}: {r['payload_bytes']} bytes{more}")
    total = dumps.log_totals(found).first()
    print(f"{total['records'] if total else 0} records, {total['incomplete'] if total else 0} incomplete, {total['bytes'] if total else 0} bytes")
    return 0


def dump_run(path: str, entries: bool = False) -> int:
    run = framed.RunReader(path)
    print(f"entries {run.entry_count}, data blocks {len(run.index)}, index offset={run.index_offset} size={run.index_bytes}")
    for i, ((key, seqno, _), offset, size) in enumerate(run.index):
        print(f"block {i}: offset={offset} size={size} last_key={key.decode(errors='backslashreplace')} seqno={seqno}")
    for i, (key, seqno, kind, value) in enumerate(run.cursor() if entries else ()):
        print(f"[{i}] {'Put' if kind == S.PUT else 'Delete'} key={key.decode(errors='backslashreplace')} seqno={seqno} value={len(value or b'')} bytes")
    return 0


def dump_manifest(spark: SparkSession, folder: str) -> int:
    system, pointer = framed._hadoop(spark, f"{folder}/CURRENT")
    if not system.exists(pointer):
        print("no CURRENT: a new folder")
        return 0
    name = manifest.check_pointer_name(spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0])
    found = files.read_log(spark, f"{folder}/{name}", S.MANIFEST_MAGIC)
    edits = files.read_edits(found)
    print(f"manifest {name}")
    for r in dumps.edit_fields(edits).orderBy("edit_idx", "place").toLocalIterator():
        print(f"edit {r['edit_idx']}: {r['field']} {r['value']}")
    live = manifest.live_files(*recovery.split_edits(edits))
    for r in manifest.level_summary(live).orderBy("level").collect():
        print(f"level {r['level']}: {r['files']} files, {r['bytes']} bytes")
    for r in manifest.version(live).orderBy("level", "ordinal").toLocalIterator():
        print(f"  [{r['file_id']}] {bytes(r['smallest_key']).decode(errors='backslashreplace')}..{bytes(r['largest_key']).decode(errors='backslashreplace')} ({r['file_bytes']} bytes)")
    bad = found.where(F.col("status") != "ok").first()
    if bad is None:
        return 0
    print(f"edit {bad['pos']}: {bad['status']}")
    return 0 if bad["status"] == E.TruncatedRecordError.code else 1


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlake.tools")
    parser.add_argument("what", choices=["log", "run", "manifest"])
    parser.add_argument("--decode", action="store_true", help="log: count the operations of each record")
    parser.add_argument("--entries", action="store_true", help="run: list the entries")
    parser.add_argument("path")
    asked = parser.parse_args(arguments)
    try:
        if asked.what == "run":
            return dump_run(asked.path, asked.entries)
        spark = spark or SparkSession.builder.getOrCreate()
        return dump_log(spark, asked.path, asked.decode) if asked.what == "log" else dump_manifest(spark, asked.path)
    except Exception as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
