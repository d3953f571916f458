"""Verification: model reads, acknowledged-state oracle, lifecycles, workloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import faults
from ledgerlake import schema as S
from ledgerlake.operators.reads import winners


def state(log: DataFrame) -> DataFrame:
    """``user_key, present, value`` of every key touched."""
    return winners(log).select("user_key", (F.col("kind") == S.PUT).alias("present"), "value")


def verify(actual: DataFrame, acked: DataFrame, pending: DataFrame) -> DataFrame:
    """Keys whose actual value is neither that of the acknowledged state nor that with the pending operations on top."""
    base = state(acked).toDF("user_key", "base_present", "base_value")
    alt = state(acked.unionByName(pending)).toDF("user_key", "alt_present", "alt_value")
    real = actual.select("user_key", F.lit(True).alias("real_present"), F.col("value").alias("real_value"))
    all3 = alt.join(base, "user_key", "left").join(real, "user_key", "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    same = lambda p: (there("real_present") == there(f"{p}_present")) & (~there("real_present") | F.col("real_value").eqNullSafe(F.col(f"{p}_value")))
    return all3.where(~(same("base") | same("alt"))).select("user_key", there("real_present").alias("present"), F.col("real_value").alias("value"))


def keys_in_order(log: DataFrame, order: str = "seqno") -> DataFrame:
    return log.groupBy("user_key").agg(F.min(order).alias("first_seen"))


def entries(log: DataFrame) -> DataFrame:
    """Entries of a model: every version counts, not every key."""
    return log.agg(F.count(F.lit(1)).alias("entries"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Status of each operation by its last event: acked, failed, or pending after a start."""
    last = events.groupBy("op_id").agg(F.max_by("event_kind", "ord").alias("last_event"), F.count(F.lit(1)).alias("events"))
    return last.withColumn("status", F.when(F.col("last_event") == "ack", "acked").when(F.col("last_event") == "fail", "failed").otherwise("pending"))


@dataclass(frozen=True)
class WorkloadConfig:
    """Shape of a generated workload. Percentages of puts, deletes and batches sum to 100."""

    operations: int = 100
    put_pct: int = 60
    delete_pct: int = 20
    batch_pct: int = 20
    hot_pct: int = 30
    keys: int = 64
    hot_keys: int = 4
    max_value: int = 128
    seed: int = 1

    def __post_init__(self):
        if self.put_pct + self.delete_pct + self.batch_pct != 100 or min(self.put_pct, self.delete_pct, self.batch_pct) < 0:
            raise E.InvalidOptionError("percentages must sum to 100")
        if self.operations < 0 or not 0 <= self.hot_pct <= 100 or not 0 < self.hot_keys <= self.keys:
            raise E.InvalidOptionError("counts")

    @classmethod
    def ci(cls) -> "WorkloadConfig":
        return cls(operations=24)


#: The prime below which draws are made, two of its primitive roots, and the streams that draws come from.
DRAW_PRIME, DRAW_ROOTS = 2_147_483_647, (48_271, 69_621)
STREAMS = {"kind": 1, "size": 2, "hot": 3, "key": 4, "item": 5, "len": 6, "value": 7, "key_bytes": 8, "key_len": 9, "value_bytes": 10, "value_len": 11}


def draw(seed: int, stream: str, op_id: F.Column, op_idx: F.Column) -> F.Column:
    """A number from 0 up to DRAW_PRIME, by congruences alone, so that SQL anywhere can state it; no product leaves 64 bits."""
    a, b = DRAW_ROOTS
    x = F.lit(seed % DRAW_PRIME * a + STREAMS[stream]) % DRAW_PRIME
    for part in (op_id % DRAW_PRIME, op_idx.cast("bigint")):
        x = ((x + part) % DRAW_PRIME * a + 12_345) % DRAW_PRIME
        x = (x.bitwiseXOR(F.shiftright(x, 15)) % DRAW_PRIME * b + 54_321) % DRAW_PRIME
    return x.bitwiseXOR(F.shiftright(x, 13)) % DRAW_PRIME


def workload(spark: SparkSession, config: WorkloadConfig = WorkloadConfig()) -> DataFrame:
    """``op_id, kind, op_idx, op_type, key, value``: repeatable, and made in parallel. Deletes of keys never put become puts."""
    of = lambda stream, n, idx=F.col("op_idx"): draw(config.seed, stream, F.col("op_id"), idx) % n
    whole = F.lit(0)
    ops = spark.range(1, config.operations + 1).withColumnRenamed("id", "op_id")
    ops = ops.withColumn("pick", of("kind", 100, whole))
    ops = ops.select("op_id", F.when(F.col("pick") < config.put_pct, "put").when(F.col("pick") < config.put_pct + config.delete_pct, "delete").otherwise("batch").alias("kind"))
    items = ops.withColumn("op_idx", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "batch", of("size", 3, whole) + 1).otherwise(0).cast("int"))))
    number = F.when(of("hot", 100) < config.hot_pct, of("key", config.hot_keys)).otherwise(of("key", config.keys))
    items = items.withColumn("key", F.format_string("key-%04d", number))
    wants_delete = (F.col("kind") == "delete") | ((F.col("kind") == "batch") & (of("item", 100) < config.delete_pct))
    items = items.withColumn("wants_delete", wants_delete)
    first = items.groupBy("key").agg(F.min(F.when(~F.col("wants_delete"), F.struct("op_id", "op_idx"))).alias("first_put"))
    items = items.join(first, "key")
    known = F.col("first_put").isNotNull() & (F.struct("op_id", "op_idx") > F.col("first_put"))
    items = items.withColumn("op_type", F.when(F.col("wants_delete") & known, S.DELETE).otherwise(S.PUT))
    digits = F.lpad(draw(config.seed, "value", F.col("op_id"), F.col("op_idx")).cast("string"), 10, "0")
    value = F.repeat(digits, -(-config.max_value // 10)).substr(F.lit(1), of("len", config.max_value + 1).cast("int"))
    return items.select("op_id", F.when((F.col("kind") == "delete") & (F.col("op_type") == S.PUT), "put").otherwise(F.col("kind")).alias("kind"), "op_idx", "op_type", "key", F.when(F.col("op_type") == S.PUT, value).alias("value"))


def random_bytes(seed: int, stream: str, op_id: F.Column, shortest: int, longest: int) -> F.Column:
    """Repeatable bytes of ``shortest`` to ``longest`` length: draws at places 0, 1, ... of four bytes each."""
    words = F.transform(F.sequence(F.lit(0), F.lit(longest // 4)), lambda i: F.lpad(F.hex(draw(seed, f"{stream}_bytes", op_id, i)), 8, "0"))
    length = (draw(seed, f"{stream}_len", op_id, F.lit(0)) % (longest - shortest + 1) + shortest).cast("int")
    return F.unhex(F.substring(F.array_join(words, ""), F.lit(1), length * 2))


def random_pairs(spark: SparkSession, n: int, max_key: int = 16, max_value: int = 64, seed: int = 1) -> DataFrame:
    """``op_id, key, value`` of ``n`` random pairs: keys of 1 to ``max_key`` bytes, values of 0 to ``max_value``."""
    if max_key < 1 or max_value < 0:
        raise E.InvalidOptionError("lengths")
    ids = spark.range(1, n + 1).withColumnRenamed("id", "op_id")
    return ids.select("op_id", random_bytes(seed, "key", F.col("op_id"), 1, max_key).alias("key"), random_bytes(seed, "value", F.col("op_id"), 0, max_value).alias("value"))


#: Settings of the named harness profiles; ``full`` is the default one. Fixed values: ``ci``.
PROFILES = {
    "full": {},
    "ci": dict(cycles=6, min_delay_ms=8, max_delay_ms=20, seed=777, ops=24, put_ratio=60, delete_ratio=20, batch_ratio=20, max_key_len=16, max_value_len=64, hot_key_ratio=35, verify_every_cycle=True),
}


@dataclass(frozen=True)
class HarnessConfig:
    """A crash run: how many cycles, when to stop them, and the workload. ``profile`` overrides what it names."""

    dbdir: str
    artifact_dir: str
    cycles: int = 50
    min_delay_ms: int = 10
    max_delay_ms: int = 100
    seed: int = 1
    ops: int = 100
    put_ratio: int = 60
    delete_ratio: int = 20
    batch_ratio: int = 20
    max_key_len: int = 32
    max_value_len: int = 128
    hot_key_ratio: int = 30
    verify_every_cycle: bool = True
    profile: str = "full"
    crash_point: str = ""
    fault_point: str = ""

    def __post_init__(self):
        if self.profile not in PROFILES:
            raise E.InvalidOptionError(f"profile {self.profile!r}")
        for name, value in PROFILES[self.profile].items():
            object.__setattr__(self, name, value)
        ratios = self.put_ratio, self.delete_ratio, self.batch_ratio
        wrong = {
            "dbdir": not self.dbdir, "artifact_dir": not self.artifact_dir, "cycles": self.cycles <= 0, "ops": self.ops <= 0,
            "min_delay_ms": self.min_delay_ms < 0, "max_delay_ms": self.max_delay_ms <= 0 or self.max_delay_ms < self.min_delay_ms,
            "ratios": min(ratios) < 0 or sum(ratios) != 100, "hot_key_ratio": not 0 <= self.hot_key_ratio <= 100,
            "max_key_len": self.max_key_len < 1, "max_value_len": self.max_value_len < 0,
            "crash_point": self.crash_point not in ("", *faults.CRASHES), "fault_point": self.fault_point not in ("", *faults.FAULTS),
        }
        if any(wrong.values()):
            raise E.InvalidOptionError(", ".join(k for k, bad in wrong.items() if bad))

    def workload(self) -> WorkloadConfig:
        return WorkloadConfig(operations=self.ops, put_pct=self.put_ratio, delete_pct=self.delete_ratio, batch_pct=self.batch_ratio, hot_pct=self.hot_key_ratio, max_value=self.max_value_len, seed=self.seed)
