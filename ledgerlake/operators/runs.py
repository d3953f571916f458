"""Sorted runs: rotation, block packing, index, footer, key ranges, compaction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions.codecs import pack_blocks
from ledgerlake.operators import reads
from ledgerlake.operators.reads import winners


def entry_size() -> Column:
    return (S.BLOCK_ENTRY + F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")


def memtable_entry() -> Column:
    """Bytes of a memtable entry with a tower of one, which makes the account repeatable."""
    return (S.MEMTABLE_NODE + F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")


def memtable_sizes(sourced: DataFrame) -> DataFrame:
    return sourced.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(memtable_entry()).alias("bytes"))


def rotate(batches: DataFrame, threshold: int) -> DataFrame:
    """``batch_id, memtable``: a memtable is frozen after the batch that takes it to ``threshold``.

    ``batches``: ``log_id, batch_id, bytes``. The rule is a running sum that starts anew, which
    nothing but a walk in order can follow; each log is one walk over a row a batch.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch_id")
        out, table, used = [], 0, 0
        for n in pdf["bytes"]:
            out.append(table)
            used += n
            if used >= threshold:
                table, used = table + 1, 0
        return pd.DataFrame({"log_id": pdf["log_id"], "batch_id": pdf["batch_id"], "memtable": out})

    return batches.select("log_id", "batch_id", "bytes").groupBy("log_id").applyInPandas(walk, "log_id bigint, batch_id bigint, memtable bigint")


def pack(runs: DataFrame, target: int = S.DEFAULT_BLOCK_BYTES) -> DataFrame:
    """Entries of runs with their position and block: ``sst_id, rn, user_key, seqno, entry_bytes, block_idx``. Runs are packed side by side."""
    keys = runs.select("sst_id", "user_key", "seqno", entry_size().alias("entry_bytes"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=pdf["user_key"].map(lambda k: k.encode())).sort_values(["o", "seqno"], ascending=[True, False]).drop(columns="o")
        return pdf.assign(rn=range(1, len(pdf) + 1), block_idx=pack_blocks(pdf["entry_bytes"].to_numpy(), target))

    return keys.groupBy("sst_id").applyInPandas(walk, "sst_id bigint, user_key string, seqno bigint, entry_bytes bigint, rn bigint, block_idx bigint")


def blocks(packed: DataFrame) -> DataFrame:
    """One row a block: entries, bytes on disk, last key and its number."""
    return packed.groupBy("sst_id", "block_idx").agg(
        F.count(F.lit(1)).alias("entries"), (F.sum("entry_bytes") + S.BLOCK_TRAILER).alias("block_bytes"),
        F.max_by("user_key", "rn").alias("last_key"), F.max_by("seqno", "rn").alias("last_seqno"),
    )


def index(block_rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("sst_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return block_rows.select("sst_id", "block_idx", "last_key", "last_seqno", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).cast("bigint").alias("block_offset"), "block_bytes")


def footers(block_rows: DataFrame) -> DataFrame:
    """One row a run: blocks, entries, index offset and size, file size."""
    f = block_rows.groupBy("sst_id").agg(
        F.count(F.lit(1)).alias("data_blocks"), F.sum("entries").alias("entry_count"), F.sum("block_bytes").alias("index_offset"),
        (F.sum(S.INDEX_ENTRY + F.octet_length("last_key")) + S.BLOCK_TRAILER).cast("bigint").alias("index_bytes"),
    )
    return f.withColumn("file_bytes", F.col("index_offset") + F.col("index_bytes") + S.FOOTER)


def find_blocks(index_rows: DataFrame, keys: DataFrame) -> DataFrame:
    """First block of each run whose last key is not below each wanted key.

    A short list of keys is broadcast; a longer one is met in one ordered pass per run.
    """
    few = keys.select(F.col("user_key").alias("wanted")).distinct()
    if few.limit(reads.SHORT_LIST + 1).count() <= reads.SHORT_LIST:
        return index_rows.join(F.broadcast(few), F.col("last_key") >= F.col("wanted")).groupBy("sst_id", "wanted").agg(F.min("block_idx").alias("block_idx"))
    held = index_rows.select("sst_id", F.col("last_key").alias("wanted"), F.lit(0).alias("asked"), "block_idx")
    asked = few.where("wanted is not null").crossJoin(F.broadcast(index_rows.select("sst_id").distinct())).select("sst_id", "wanted", F.lit(1).alias("asked"), F.lit(None).cast(held.schema["block_idx"].dataType).alias("block_idx"))  # a row of the result each
    back = Window.partitionBy("sst_id").orderBy(F.desc("wanted"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.unionByName(asked).withColumn("block_idx", F.min("block_idx").over(back)).where("asked = 1 and block_idx is not null").select("sst_id", "wanted", "block_idx")


def key_ranges(runs: DataFrame) -> DataFrame:
    """Smallest and largest internal key of each run."""
    o = F.struct("user_key", -F.col("seqno"))
    both = runs.groupBy("sst_id").agg(F.min(o).alias("lo"), F.max(o).alias("hi"), F.count(F.lit(1)).alias("entries"), F.max("seqno").alias("max_seqno"))
    return both.select("sst_id", F.col("lo.user_key").alias("smallest_key"), (-F.col("lo.col2")).alias("smallest_seqno"), F.col("hi.user_key").alias("largest_key"), (-F.col("hi.col2")).alias("largest_seqno"), "entries", "max_seqno")


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet. One row a run goes in: metadata, not data."""
    a, b = (ranges.select(*[F.col(c).alias(f"{p}_{c}") for c in ("sst_id", "smallest_key", "largest_key")]) for p in "ab")
    hit = (F.col("a_sst_id") < F.col("b_sst_id")) & (F.col("a_smallest_key") <= F.col("b_largest_key")) & (F.col("b_smallest_key") <= F.col("a_largest_key"))
    return a.join(b, hit).select("a_sst_id", "b_sst_id")


def prune(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """Runs whose range may hold each wanted key. ``ranges``: one row a run, so broadcast; keys may be any number."""
    wanted = keys.select(F.col("user_key").alias("wanted")).distinct()
    return wanted.join(F.broadcast(ranges), F.col("wanted").between(F.col("smallest_key"), F.col("largest_key"))).select("wanted", "sst_id")


def compact(runs: DataFrame, chosen=None, oldest_included: bool = True, snapshots: tuple[int, ...] = ()) -> DataFrame:
    """Versions that survive a merge of the chosen runs: ``user_key, kind, value, seqno``.

    The newest version of each key stays, and the newest at or below each live snapshot.
    Tombstones go if the oldest run takes part and no snapshot is live; else they still hide
    something.
    """
    if chosen is not None:
        runs = runs.where(chosen)
    if not snapshots:
        kept = winners(runs)
        return kept.where(F.col("kind") == S.PUT) if oldest_included else kept
    layer = F.lit(len(snapshots))
    for i, s in reversed(list(enumerate(sorted(snapshots)))):
        layer = F.when(F.col("seqno") <= s, i).otherwise(layer)
    kept = runs.groupBy("user_key", layer.alias("layer")).agg(F.max_by(F.struct("kind", "value", "seqno"), "seqno").alias("w"))
    return kept.select("user_key", "w.*")


def space_amplification(runs: DataFrame) -> DataFrame:
    """Bytes of all entries and of the live ones."""
    total = runs.agg(F.sum(entry_size()).alias("total_bytes"))
    live = winners(runs).where(F.col("kind") == S.PUT).agg(F.coalesce(F.sum(entry_size()), F.lit(0)).alias("live_bytes"))
    return total.crossJoin(live).withColumn("ratio", F.col("total_bytes").cast("double") / F.nullif(F.col("live_bytes"), F.lit(0)).cast("double"))  # one row each
