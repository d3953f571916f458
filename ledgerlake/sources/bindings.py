"""Bindings of plain tables to changelogs, batches and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schema as S

#: Operations of one write batch, and of one explicit flush.
BATCH_OPS, RUN_OPS = 10, 768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(df: DataFrame, key, seq, deleted, value) -> DataFrame:
    return df.select(
        key.cast("string").alias("user_key"),
        (seq + 1).cast("bigint").alias("seqno"),
        F.when(deleted, S.DELETE).otherwise(S.PUT).alias("kind"),
        F.when(~deleted, value).alias("value"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a changelog: the user is the key, an error deletes it."""
    e = table(spark, sf_dir, "events")
    return _log(e, F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("event_type"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return _log(o, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_orderpriority"))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return _log(d, F.col("doc_id"), F.col("doc_id"), F.lit(False), F.col("text"))


def with_batches(log: DataFrame, size: int = BATCH_OPS) -> DataFrame:
    return log.withColumn("batch_id", F.expr(f"(seqno - 1) div {size}")).withColumn("op_idx", (F.pmod(F.col("seqno") - 1, F.lit(size))).cast("int"))


def with_sources(log: DataFrame, size: int = RUN_OPS) -> DataFrame:
    """``source_rank`` (higher: newer) and ``source``: runs of ``size`` operations, the last, incomplete one in memory."""
    last = log.agg(F.max("seqno")).first()[0] or 0
    rank = F.expr(f"(seqno - 1) div {size} + 1")
    return log.withColumn("source_rank", rank).withColumn("source", F.when(rank * size <= last, F.concat(F.lit("sst-"), rank.cast("string"))).otherwise("mem"))


def with_runs(log: DataFrame, size: int = RUN_OPS) -> DataFrame:
    """Every operation with the run that it is flushed to."""
    return log.withColumn("sst_id", F.expr(f"(seqno - 1) div {size} + 1"))
