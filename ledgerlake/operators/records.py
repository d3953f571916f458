"""Log records: offsets, valid prefix, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.operators.changelog import prefix_sum


def offsets(batches: DataFrame) -> DataFrame:
    """``start_offset`` and ``end_offset`` of the record of each batch (``batch_id, encoded_bytes``)."""
    sized = batches.withColumn("record_bytes", F.col("encoded_bytes") + S.RECORD_HEADER)
    return prefix_sum(sized, "batch_id", "record_bytes", "start_offset").withColumn("end_offset", F.col("start_offset") + F.col("record_bytes"))


def valid_prefix(records: DataFrame, order: str = "pos") -> DataFrame:
    """Records before the first bad one. The bound is one row, joined as such."""
    first_bad = records.where("status <> 'ok'").agg(F.min(order).alias("bad_"))
    return records.crossJoin(F.broadcast(first_bad)).where(F.col("bad_").isNull() | (F.col(order) < F.col("bad_"))).drop("bad_")


def check_tail(records: DataFrame, order: str = "pos") -> str:
    """``clean`` or ``torn``; raises where anything but a torn last record is bad."""
    bad = records.where("status <> 'ok'").groupBy().agg(F.min(F.struct(order, "status")).alias("b")).first()["b"]
    if bad is None:
        return "clean"
    if bad["status"] != E.TruncatedRecordError.code or not records.where(F.col(order) > bad[order]).isEmpty():
        raise E.CorruptLogError(f"record {bad[order]}: {bad['status']}")
    return "torn"


def dump(records: DataFrame) -> DataFrame:
    """One line a record with running totals: index, bytes, operations."""
    out = prefix_sum(records, "batch_id", "op_count", "ops_before")
    return out.select("batch_id", "op_count", "encoded_bytes", "start_offset", "end_offset", (F.col("ops_before") + F.col("op_count")).alias("ops_so_far"))
