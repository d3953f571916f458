"""Write-side operators: batches, sequence numbers, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions import codecs

CHUNK = 65_536


class Batch:
    """Operations that a store writes as one. Keys and values are copied; empty ones are allowed."""

    def __init__(self, ops: tuple[tuple[int, bytes, bytes | None], ...] = ()):
        self.ops = list(ops)

    def put(self, key: bytes, value: bytes) -> "Batch":
        self.ops.append((S.PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> "Batch":
        self.ops.append((S.DELETE, bytes(key), None))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def clear(self) -> None:
        self.ops = []

    def clone(self) -> "Batch":
        return Batch(tuple(self.ops))

    def encode(self) -> bytes:
        return codecs.encode_batch(self.ops)

    @classmethod
    def decode(cls, data: bytes) -> "Batch":
        return cls(tuple(codecs.decode_batch(data)))


def prefix_sum(rows: DataFrame, order: str, amount: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows before each row by a dense integer ``order``.

    Rows are summed in chunks of the order, so no task sorts more than a chunk; only one row a
    chunk goes through the window over all chunks.
    """
    cut = rows.withColumn("chunk_", F.expr(f"`{order}` div {chunk}"))
    totals = cut.groupBy("chunk_").agg(F.sum(amount).alias("total_"))
    before = Window.orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("chunk_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("chunk_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(starts, "chunk_").withColumn(out, F.col("start_") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("chunk_", "start_")


def assign_seqnos(batches: DataFrame, base: int = 0) -> DataFrame:
    """``batch_id, op_count`` with the sequence number before the first operation of each batch. Empty batches take none."""
    return prefix_sum(batches.where("op_count > 0"), "batch_id", "op_count", "base_seqno").withColumn("base_seqno", F.col("base_seqno") + base)


def explode_batches(batches: DataFrame, base: int = 0) -> DataFrame:
    """Changelog of ``batch_id, ops``: operations get consecutive numbers in the order of batch and position."""
    sized = batches.withColumn("op_count", F.size("ops").cast("bigint")).where("op_count > 0")
    numbered = prefix_sum(sized, "batch_id", "op_count", "base_seqno")
    return numbered.select("batch_id", "base_seqno", F.posexplode("ops").alias("op_idx", "op")).select(
        F.col("op.key").alias("user_key"), (F.col("base_seqno") + F.col("op_idx") + 1 + base).alias("seqno"), F.col("op.op_type").alias("kind"),
        F.when(F.col("op.op_type") == S.PUT, F.coalesce(F.col("op.value"), F.lit(b""))).alias("value"), "batch_id", "op_idx",
    )


def collect_batches(log: DataFrame) -> DataFrame:
    """``batch_id, ops`` of a changelog with ``batch_id, op_idx``; operations stay in order."""
    op = F.struct("op_idx", F.col("kind").alias("op_type"), F.col("user_key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    ops = F.transform(F.sort_array(F.collect_list(op)), lambda o: F.struct(o["op_type"].alias("op_type"), o["key"].alias("key"), o["value"].alias("value")))
    return log.groupBy("batch_id").agg(ops.alias("ops"))


def batch_stats(log: DataFrame) -> DataFrame:
    """Operations, puts, deletes and encoded bytes of each batch, without gathering them."""
    puts = F.when(F.col("kind") == S.PUT, 1).otherwise(0)
    size = 5 + F.octet_length("user_key") + F.when(F.col("kind") == S.PUT, 4 + F.octet_length("value")).otherwise(0)
    return log.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("op_count"), F.sum(puts).cast("bigint").alias("puts"), (F.count(F.lit(1)) - F.sum(puts)).cast("bigint").alias("deletes"),
        (F.sum(size) + S.BATCH_HEADER).cast("bigint").alias("encoded_bytes"),
    )


def last_of_batch(log: DataFrame) -> DataFrame:
    """The operation of each key that wins inside its batch."""
    return log.groupBy("batch_id", "user_key").agg(F.max_by(F.struct("kind", "value", "op_idx"), "op_idx").alias("w")).select("batch_id", "user_key", "w.kind", "w.value", "w.op_idx")
