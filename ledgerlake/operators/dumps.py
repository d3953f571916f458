"""What the dump tools print, as frames: log records, blocks of runs, edits of a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.functions import codecs


def log_records(found: DataFrame, decode: bool = False) -> DataFrame:
    """``path, pos, payload_bytes, status`` of log records up to the first bad one of each file; with ``decode`` also ``op_count`` and ``error``.

    A payload that is no batch has an error code and no count.
    """
    out = found.select("path", "pos", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "status", "payload")
    if not decode:
        return out.drop("payload")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            counts, errors = [], []
            for data in pdf["payload"]:
                try:
                    counts.append(None if data is None else len(codecs.decode_batch(bytes(data))))
                    errors.append(None)
                except E.CodecError as e:
                    counts.append(None)
                    errors.append(e.code)
            yield pdf.drop(columns="payload").assign(payload_bytes=pdf["payload_bytes"].astype("Int64"), op_count=pd.Series(counts, dtype="Int64", index=pdf.index), error=errors)

    return out.mapInPandas(run, "path string, pos bigint, payload_bytes bigint, status string, op_count bigint, error string")


def log_totals(dumped: DataFrame) -> DataFrame:
    """Complete and incomplete records and payload bytes of each file."""
    ok = F.col("status") == "ok"
    return dumped.groupBy("path").agg(F.count_if(ok).alias("records"), F.count_if(~ok).alias("incomplete"), F.coalesce(F.sum(F.when(ok, F.col("payload_bytes"))), F.lit(0)).alias("bytes"))


def run_entries(entries: DataFrame) -> DataFrame:
    """Entries of runs without their values."""
    return entries.select("sst_id", "position", F.when(F.col("kind") == S.PUT, "Put").otherwise("Delete").alias("kind"), F.col("user_key").cast("string").alias("user_key"), "seqno", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint").alias("value_bytes"))


def _key(c: Column) -> Column:
    return codecs.key_text(c["user_key"], c["seqno"], c["kind"])


def edit_fields(edits: DataFrame) -> DataFrame:
    """One row for each field that an edit sets: ``edit_idx, place, field, value``."""
    line = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    plain = [F.when(F.col(c).isNotNull(), F.array(line(c, F.col(c).cast("string")))).otherwise(F.array().cast("array<struct<field:string,value:string>>")) for c in ("next_file_id", "last_sequence", "log_number")]
    adds = F.transform("added", lambda f: line("add_file", F.format_string("level=%d id=%d size=%d smallest=%s largest=%s", f["level"], f["file_id"], f["size"], _key(f["smallest"]), _key(f["largest"]))))
    gone = F.transform("deleted", lambda f: line("delete_file", F.format_string("level=%d id=%d", f["level"], f["file_id"])))
    return edits.select("edit_idx", F.posexplode(F.concat(*plain, adds, gone)).alias("place", "f")).select("edit_idx", "place", "f.field", "f.value")
