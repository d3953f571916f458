"""Files: framed logs, run files, directory listings, NDJSON operations and events."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.functions import codecs

ITEM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key_b64", T.StringType()), T.StructField("value_b64", T.StringType())])
OPERATION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("op_id", T.LongType()), T.StructField("key_b64", T.StringType()), T.StructField("value_b64", T.StringType()), T.StructField("batch", T.ArrayType(ITEM))])
EVENT = T.StructType(
    [
        T.StructField("cycle", T.IntegerType()),
        T.StructField("time_unix_ms", T.LongType()),
        T.StructField("event", T.StructType([T.StructField("kind", T.StringType()), T.StructField("op_id", T.LongType()), T.StructField("error", T.StringType()), T.StructField("point", T.StringType())])),
    ]
)
ARTIFACT_VERSION = 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one only where both are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise E.InvalidOptionError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str | list[str], magic: bytes = S.WAL_MAGIC) -> DataFrame:
    """Records of log files: ``path, pos, start_offset, end_offset, payload, status``; each file ends at its first bad record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(name, *r) for r in codecs.read_records(bytes(data), magic)], columns=["path", "pos", "start_offset", "end_offset", "payload", "status"])

    return files.mapInPandas(run, "path string, pos bigint, start_offset bigint, end_offset bigint, payload binary, status string")


def read_batches(log_records: DataFrame) -> DataFrame:
    """``batch_id, ops`` of valid records; a payload that is no batch raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ops = [[{"op_type": t, "key": k, "value": v} for t, k, v in codecs.decode_batch(bytes(x))] for x in pdf["payload"]]
            yield pd.DataFrame({"batch_id": pdf["pos"], "ops": ops})

    return log_records.where("status = 'ok'").select("pos", "payload").mapInPandas(run, S.BATCH)


def read_edits(manifest_records: DataFrame) -> DataFrame:
    """Edits of valid manifest records."""

    def key(k):
        return {"user_key": k[0], "seqno": k[1], "kind": k[2]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for pos, payload in zip(pdf["pos"], pdf["payload"]):
                e = codecs.decode_edit(bytes(payload))
                e["deleted"] = [{"level": a, "file_id": b} for a, b in e["deleted"]]
                e["added"] = [{"level": a, "file_id": b, "size": n, "smallest": key(lo), "largest": key(hi)} for a, b, n, lo, hi in e["added"]]
                rows.append({"edit_idx": pos, **e})
            out = pd.DataFrame(rows, columns=S.EDIT.names)
            for c in ("next_file_id", "last_sequence", "log_number"):
                out[c] = out[c].astype("Int64")
            yield out

    return manifest_records.where("status = 'ok'").select("pos", "payload").mapInPandas(run, S.EDIT)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of run files: ``file_id, user_key, seqno, kind, value``; checksums and counts are verified."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d{20})\.sst$", 1).try_cast("bigint").alias("file_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for number, data in zip(pdf["file_id"], pdf["content"]):
                yield pd.DataFrame([(number, *e) for e in codecs.decode_run(bytes(data))], columns=["file_id", "user_key", "seqno", "kind", "value"])

    return files.mapInPandas(run, "file_id bigint, user_key binary, seqno bigint, kind int, value binary")


def list_names(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name`` of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """``op_id, op_idx, op_type, key, value`` of NDJSON operations. An unknown kind or bad base64 raises."""
    raw = spark.read.schema(OPERATION).json(path)
    single = F.array(F.struct("kind", "key_b64", "value_b64").cast(ITEM))
    items = raw.select(F.coalesce("op_id", F.lit(0)).alias("op_id"), "kind", F.posexplode(F.when(F.col("kind") == "batch", F.col("batch")).otherwise(single)).alias("op_idx", "item"))
    kind = F.col("item.kind")
    op_type = F.when(kind == "put", S.PUT).when(kind == "delete", S.DELETE).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("int"))
    bytes_of = lambda c: F.unbase64(F.coalesce(c, F.lit("")))
    strict = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z0-9+/]*={0,2}$"), bytes_of(c)).otherwise(F.raise_error(F.lit("bad base64")).cast("binary"))
    return items.select("op_id", "op_idx", op_type.alias("op_type"), strict(F.col("item.key_b64")).alias("key"), F.when(op_type == S.PUT, strict(F.col("item.value_b64"))).alias("value"))


def operations_json(ops: DataFrame) -> DataFrame:
    """NDJSON lines (``value``) of ``op_id, op_idx, op_type, key, value``; several items are a batch."""
    word = F.when(F.col("op_type") == S.PUT, "put").otherwise("delete")
    text = lambda c: F.nullif(F.base64(c), F.lit(""))
    item = F.struct("op_idx", word.alias("kind"), text("key").alias("key_b64"), text("value").alias("value_b64"))
    grouped = ops.groupBy("op_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    bare = F.transform("items", lambda x: F.struct(x["kind"].alias("kind"), x["key_b64"].alias("key_b64"), x["value_b64"].alias("value_b64")))
    one = F.size("items") == 1
    first = F.col("items")[0]
    line = F.struct(F.when(one, first["kind"]).otherwise("batch").alias("kind"), "op_id", F.when(one, first["key_b64"]).alias("key_b64"), F.when(one, first["value_b64"]).alias("value_b64"), F.when(~one, bare).alias("batch"))
    return grouped.select(F.to_json(line).alias("value"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Harness events; an operation id that is left out is 0."""
    raw = spark.read.schema(EVENT).json(path)
    return raw.select("cycle", "time_unix_ms", F.col("event.kind").alias("event_kind"), F.when(F.col("event.kind") != "ready", F.coalesce("event.op_id", F.lit(0))).alias("op_id"), F.col("event.error").alias("error"), F.col("event.point").alias("point"))


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("multiLine", True).json(path)
    if "version" not in found.columns or found.where(F.col("version") != ARTIFACT_VERSION).limit(1).count():
        raise E.StoreError("unsupported artifact version")
    return found


def artifact_json(config: dict, operations: list[dict], cycles: list[dict], events: list[dict], **more) -> str:
    """A harness run as JSON: effective configuration, seed, operations, cycles, events; of ``more`` what is set."""
    made = {"version": ARTIFACT_VERSION, "config": config, "seed": config.get("seed"), "ops": operations, "cycles": cycles, "events": events}
    return json.dumps(made | {k: v for k, v in more.items() if v}, indent=2) + "\n"
