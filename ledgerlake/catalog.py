"""Registry of the engine's queries and the SQL that states the same results.

Events are the primary changelog (the user is the key, an error deletes it), orders the one
with many keys. Batches are ten operations, runs 768, the last incomplete run is in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schema as S
from ledgerlake.functions import codecs
from ledgerlake.operators import changelog, dumps, manifest, reads, records, runs, verify
from ledgerlake.plans import recovery
from ledgerlake.plans.store import Store
from ledgerlake.sources import bindings as B
from ledgerlake.sources import files, framed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS user_key, event_id + 1 AS seqno,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events)"""
ORDERS = """log AS (SELECT CAST(o_custkey AS VARCHAR) AS user_key, o_orderkey + 1 AS seqno,
    CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS kind,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"""
TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn FROM log)"
SOURCED = f"""src AS (SELECT *, (seqno - 1) // {B.RUN_OPS} + 1 AS source_rank,
    CASE WHEN ((seqno - 1) // {B.RUN_OPS} + 1) * {B.RUN_OPS} <= (SELECT max(seqno) FROM log)
         THEN 'sst-' || CAST((seqno - 1) // {B.RUN_OPS} + 1 AS VARCHAR) ELSE 'mem' END AS source FROM log)"""
RUNS = f"runs AS (SELECT *, (seqno - 1) // {B.RUN_OPS} + 1 AS sst_id FROM log)"
BATCHED = f"bat AS (SELECT *, (seqno - 1) // {B.BATCH_OPS} AS batch_id, (seqno - 1) % {B.BATCH_OPS} AS op_idx FROM log)"
SIZES = """siz AS (SELECT batch_id, count(*) AS op_count, CAST(sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS BIGINT) AS puts,
    CAST(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS BIGINT) AS deletes,
    CAST(8 + sum(5 + strlen(user_key) + CASE WHEN kind = 1 THEN 4 + strlen(value) ELSE 0 END) AS BIGINT) AS encoded_bytes
    FROM bat GROUP BY batch_id)"""
OFFSETS = """off AS (SELECT batch_id, op_count, encoded_bytes,
    CAST(coalesce(sum(encoded_bytes + 18) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset,
    CAST(sum(encoded_bytes + 18) OVER (ORDER BY batch_id) AS BIGINT) AS end_offset FROM siz)"""
KEYS = [str(k) for k in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)] + ["missing", ""]
KEYS_SQL = "wanted AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}')" for k in KEYS) + ") t(user_key))"
BLOCK_TARGET, ROTATE_AT = 512, 4096
PACKED = f"""ent AS (SELECT sst_id, user_key, seqno, CAST(17 + strlen(user_key) + coalesce(strlen(value), 0) AS BIGINT) AS n,
        row_number() OVER (PARTITION BY sst_id ORDER BY user_key, seqno DESC) AS rn FROM runs),
    pk AS (SELECT sst_id, rn, CAST(0 AS BIGINT) AS block_idx, n AS used FROM ent WHERE rn = 1
        UNION ALL SELECT e.sst_id, e.rn, CASE WHEN p.used + e.n > {BLOCK_TARGET} THEN p.block_idx + 1 ELSE p.block_idx END,
            CASE WHEN p.used + e.n > {BLOCK_TARGET} THEN e.n ELSE p.used + e.n END
        FROM pk p JOIN ent e ON e.sst_id = p.sst_id AND e.rn = p.rn + 1),
    packed AS (SELECT e.sst_id, e.rn, e.user_key, e.seqno, e.n, p.block_idx FROM ent e JOIN pk p ON e.sst_id = p.sst_id AND e.rn = p.rn),
    blk AS (SELECT sst_id, block_idx, count(*) AS entries, CAST(sum(n) + 4 AS BIGINT) AS block_bytes,
        arg_max(user_key, rn) AS last_key, arg_max(seqno, rn) AS last_seqno FROM packed GROUP BY sst_id, block_idx)"""
RANGES = """rng AS (SELECT sst_id, min(user_key) AS smallest_key, arg_min(seqno, {'k': user_key, 's': -seqno}) AS smallest_seqno,
    max(user_key) AS largest_key, arg_max(seqno, {'k': user_key, 's': -seqno}) AS largest_seqno, count(*) AS entries, max(seqno) AS max_seqno FROM runs GROUP BY sst_id)"""


def query(*ctes: str, sql: str | None = None):
    """Register a query and, if it has any, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE " if any("pk AS" in c or "rot AS" in c for c in ctes) else "WITH "
            ORACLE_SQL[f.__name__] = (head + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KEYS], "user_key string")


# --- reads ---------------------------------------------------------------------------------


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1")
def kv_latest(spark, d):
    return reads.latest(B.events_log(spark, d))


@query(ORDERS, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1")
def kv_latest_orders(spark, d):
    return reads.latest(B.orders_log(spark, d))


@query(LOG, sql="""SELECT user_key, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn
    FROM log WHERE seqno <= 5000) WHERE rn = 1 AND kind = 1""")  # fmt: skip
def kv_snapshot(spark, d):
    return reads.latest(B.events_log(spark, d), 5000)


@query(LOG, TOP, KEYS_SQL, sql="""SELECT w.user_key, CASE WHEN t.kind IS NULL THEN 'absent' WHEN t.kind = 2 THEN 'deleted' ELSE 'found' END AS status, t.value
    FROM wanted w LEFT JOIN top t ON w.user_key = t.user_key AND t.rn = 1""")  # fmt: skip
def kv_get_status(spark, d):
    return reads.get_many(B.events_log(spark, d), wanted(spark))


@query(LOG, sql="SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS version_no FROM log WHERE user_key >= '5'")
def kv_history(spark, d):
    return reads.history(B.events_log(spark, d), "5").withColumn("version_no", F.col("version_no").cast("bigint"))


@query(LOG, KEYS_SQL, sql="""SELECT w.user_key AS target, min(l.user_key) AS user_key, arg_min(l.seqno, {'k': l.user_key, 's': -l.seqno}) AS seqno,
    arg_min(l.kind, {'k': l.user_key, 's': -l.seqno}) AS kind FROM wanted w LEFT JOIN log l ON l.user_key >= w.user_key GROUP BY w.user_key""")  # fmt: skip
def kv_seek(spark, d):
    return reads.seek(B.events_log(spark, d), wanted(spark).select(F.col("user_key").alias("target")))


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1 AND user_key >= '10' AND user_key < '3'")
def kv_range_scan(spark, d):
    return reads.scan_range(B.events_log(spark, d), "10", "3")


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1 AND starts_with(user_key, '1')")
def kv_prefix_scan(spark, d):
    return reads.scan_prefix(B.events_log(spark, d), "1")


@query(LOG, TOP, sql="SELECT user_key, seqno FROM top WHERE rn = 1 AND kind = 2")
def kv_tombstones(spark, d):
    return reads.tombstones(B.events_log(spark, d))


@query(LOG, sql="SELECT user_key, seqno FROM (SELECT *, lag(kind) OVER (PARTITION BY user_key ORDER BY seqno) AS before FROM log) WHERE kind = 1 AND before = 2")
def kv_resurrected(spark, d):
    return reads.resurrected(B.events_log(spark, d))


@query(LOG, SOURCED, sql="""SELECT user_key, value, seqno, source FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY source_rank DESC, seqno DESC) AS rn
    FROM src) WHERE rn = 1 AND kind = 1""")  # fmt: skip
def kv_multi_source_get(spark, d):
    return reads.latest(B.with_sources(B.events_log(spark, d)), order=reads.by_source(), carry=("source",))


@query(LOG, SOURCED, sql="""SELECT user_key, source, (SELECT max(source_rank) FROM src) - source_rank + 1 AS probed FROM
    (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY source_rank DESC, seqno DESC) AS rn FROM src) WHERE rn = 1""")  # fmt: skip
def kv_source_hit(spark, d):
    return reads.source_hits(B.with_sources(B.events_log(spark, d)))


@query(LOG, RUNS, sql="SELECT user_key, count(DISTINCT sst_id) AS runs, count(*) AS versions FROM runs GROUP BY user_key")
def kv_read_amplification(spark, d):
    return reads.read_amplification(B.with_runs(B.events_log(spark, d)))


@query(LOG, """req AS (SELECT DISTINCT CAST(o_custkey % 200 AS VARCHAR) AS user_key, o_orderkey * 7 % 12000 AS snapshot FROM orders)""",
    sql="""SELECT r.user_key, r.snapshot, CASE WHEN l.kind IS NULL THEN 'absent' WHEN l.kind = 2 THEN 'deleted' ELSE 'found' END AS status, l.value, l.seqno
    FROM req r ASOF LEFT JOIN log l ON r.user_key = l.user_key AND r.snapshot >= l.seqno""")  # fmt: skip
def kv_asof_multi_get(spark, d):
    o = B.table(spark, d, "orders")
    req = o.select((F.col("o_custkey") % 200).cast("string").alias("user_key"), (F.col("o_orderkey") * 7 % 12000).alias("snapshot")).distinct()
    return reads.get_as_of(B.events_log(spark, d), req)


# --- batches and the log -------------------------------------------------------------------


@query(LOG, BATCHED, sql="""SELECT batch_id, user_key, kind, value, CAST(op_idx AS INTEGER) AS op_idx FROM
    (SELECT *, row_number() OVER (PARTITION BY batch_id, user_key ORDER BY op_idx DESC) AS rn FROM bat) WHERE rn = 1""")  # fmt: skip
def kv_lww_batch(spark, d):
    return changelog.last_of_batch(B.with_batches(B.events_log(spark, d)))


@query("""b AS (SELECT o_custkey AS batch_id, count(*) AS op_count FROM orders GROUP BY o_custkey)""",
    sql="SELECT batch_id, op_count, CAST(coalesce(sum(op_count) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_seqno FROM b")
def seqno_assign(spark, d):
    b = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("op_count"))
    return changelog.assign_seqnos(b)


@query(LOG, sql="SELECT user_key, seqno, kind, value FROM log")
def batch_explode(spark, d):
    batches = changelog.collect_batches(B.with_batches(B.events_log(spark, d)))
    e = changelog.explode_batches(batches)
    return e.select(F.col("user_key").cast("string").alias("user_key"), "seqno", "kind", F.col("value").cast("string").alias("value"))


@query(LOG, BATCHED, SIZES, sql="SELECT batch_id, op_count, puts, deletes, encoded_bytes FROM siz")
def batch_stats(spark, d):
    return changelog.batch_stats(B.with_batches(B.events_log(spark, d)))


@query(LOG, BATCHED, SIZES, sql="SELECT batch_id, encoded_bytes FROM siz")
def batch_encoded_size(spark, d):
    batches = changelog.collect_batches(B.with_batches(B.events_log(spark, d)))
    return batches.select("batch_id", codecs.batch_bytes(F.col("ops")).alias("encoded_bytes"))


@query(LOG, BATCHED, SIZES, OFFSETS, sql="SELECT batch_id, start_offset, end_offset FROM off")
def wal_offsets(spark, d):
    return records.offsets(changelog.batch_stats(B.with_batches(B.events_log(spark, d)))).select("batch_id", "start_offset", "end_offset")


@query(LOG, BATCHED, SIZES, OFFSETS, sql="""SELECT batch_id, op_count, encoded_bytes, start_offset, end_offset,
    CAST(sum(op_count) OVER (ORDER BY batch_id) AS BIGINT) AS ops_so_far FROM off""")  # fmt: skip
def wal_dump(spark, d):
    return records.dump(records.offsets(changelog.batch_stats(B.with_batches(B.events_log(spark, d)))))


STATUS = "CASE WHEN batch_id % 701 = 700 THEN 'checksum' WHEN batch_id % 613 = 612 THEN 'truncated' ELSE 'ok' END"
STATED = f"rec AS (SELECT *, {STATUS} AS status FROM bat)"
PREFIX = "good AS (SELECT * FROM rec WHERE batch_id < coalesce((SELECT min(batch_id) FROM rec WHERE status <> 'ok'), 9223372036854775807))"


def _stated(spark, d):
    return B.with_batches(B.events_log(spark, d)).withColumn("status", F.expr(STATUS))


@query(LOG, BATCHED, STATED, PREFIX, sql="SELECT DISTINCT batch_id FROM good")
def wal_valid_prefix(spark, d):
    return records.valid_prefix(_stated(spark, d).select("batch_id", "status").distinct(), "batch_id").select("batch_id")


@query(LOG, BATCHED, STATED, PREFIX, sql="""SELECT user_key, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn
    FROM good) WHERE rn = 1 AND kind = 1""")  # fmt: skip
def wal_replay_state(spark, d):
    return reads.latest(records.valid_prefix(_stated(spark, d), "batch_id"))


@query(LOG, sql="SELECT k.reopens, k.reopens * (SELECT count(*) FROM log) + (SELECT max(seqno) FROM log) AS last_seqno, (k.reopens + 1) * (SELECT count(*) FROM log) AS versions FROM (VALUES (0), (1), (2), (3)) k(reopens)")
def wal_replay_drift(spark, d):
    """Numbers after k opens that replay the whole log on top of what they hold, as an engine without log truncation would."""
    n = B.events_log(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("seqno").alias("m"))
    k = spark.range(4).select(F.col("id").cast("int").alias("reopens"))
    return k.crossJoin(n).select("reopens", (F.col("reopens") * F.col("n") + F.col("m")).alias("last_seqno"), ((F.col("reopens") + 1) * F.col("n")).alias("versions"))


# --- runs ----------------------------------------------------------------------------------


def _runs(spark, d):
    return B.with_runs(B.events_log(spark, d))


@query(LOG, RUNS, RANGES, sql="SELECT * FROM rng")
def run_key_range(spark, d):
    return runs.key_ranges(_runs(spark, d))


@query(LOG, RUNS, RANGES, sql="""SELECT a.sst_id AS a_sst_id, b.sst_id AS b_sst_id FROM rng a JOIN rng b ON a.sst_id < b.sst_id
    AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key""")  # fmt: skip
def run_overlap(spark, d):
    return runs.overlaps(runs.key_ranges(_runs(spark, d)))


@query(LOG, RUNS, RANGES, KEYS_SQL, sql="SELECT w.user_key AS wanted, sst_id FROM wanted w JOIN rng ON w.user_key BETWEEN smallest_key AND largest_key")
def run_prune(spark, d):
    return runs.prune(runs.key_ranges(_runs(spark, d)), wanted(spark))


@query(LOG, SOURCED, sql="SELECT source, count(*) AS entries, CAST(sum(41 + strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM src GROUP BY source")
def memtable_size(spark, d):
    return runs.memtable_sizes(B.with_sources(B.events_log(spark, d)))


@query(LOG, BATCHED, """per AS (SELECT batch_id, CAST(sum(41 + strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM bat GROUP BY batch_id)""",
    f"""rot AS (SELECT batch_id, CAST(0 AS BIGINT) AS memtable, bytes AS used FROM per WHERE batch_id = 0
        UNION ALL SELECT p.batch_id, CASE WHEN r.used >= {ROTATE_AT} THEN r.memtable + 1 ELSE r.memtable END,
            CASE WHEN r.used >= {ROTATE_AT} THEN p.bytes ELSE r.used + p.bytes END FROM rot r JOIN per p ON p.batch_id = r.batch_id + 1)""",
    sql="SELECT batch_id, memtable FROM rot")
def flush_rotation(spark, d):
    per = B.with_batches(B.events_log(spark, d)).groupBy("batch_id").agg(F.sum(runs.memtable_entry()).alias("bytes")).withColumn("log_id", F.lit(0).cast("bigint"))
    return runs.rotate(per, ROTATE_AT).select("batch_id", "memtable")


def _blocks(spark, d):
    return runs.blocks(runs.pack(_runs(spark, d), BLOCK_TARGET))


@query(LOG, RUNS, PACKED, sql="SELECT sst_id, block_idx, entries, block_bytes, last_key, last_seqno FROM blk")
def sst_blocks(spark, d):
    return _blocks(spark, d)


INDEXED = """idx AS (SELECT sst_id, block_idx, last_key, last_seqno, CAST(coalesce(sum(block_bytes) OVER (PARTITION BY sst_id ORDER BY block_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset, block_bytes FROM blk)"""
FOOTERS = """foot AS (SELECT sst_id, count(*) AS data_blocks, CAST(sum(entries) AS BIGINT) AS entry_count, CAST(sum(block_bytes) AS BIGINT) AS index_offset,
    CAST(sum(25 + strlen(last_key)) + 4 AS BIGINT) AS index_bytes, CAST(sum(block_bytes) + sum(25 + strlen(last_key)) + 44 AS BIGINT) AS file_bytes FROM blk GROUP BY sst_id)"""


@query(LOG, RUNS, PACKED, INDEXED, sql="SELECT * FROM idx")
def sst_index(spark, d):
    return runs.index(_blocks(spark, d))


@query(LOG, RUNS, PACKED, FOOTERS, sql="SELECT * FROM foot")
def sst_footer(spark, d):
    return runs.footers(_blocks(spark, d))


@query(LOG, RUNS, PACKED, KEYS_SQL, sql="SELECT sst_id, w.user_key AS wanted, min(block_idx) AS block_idx FROM blk JOIN wanted w ON last_key >= w.user_key GROUP BY sst_id, w.user_key")
def sst_block_lookup(spark, d):
    return runs.find_blocks(runs.index(_blocks(spark, d)), wanted(spark))


@query(LOG, RUNS, PACKED, RANGES, FOOTERS, sql="""SELECT f.sst_id, f.data_blocks, f.entry_count, f.file_bytes, r.smallest_key || '/' || CAST(r.smallest_seqno AS VARCHAR) || '/' ||
    (SELECT CASE WHEN kind = 1 THEN 'Put' ELSE 'Delete' END FROM log WHERE seqno = r.smallest_seqno) AS smallest FROM foot f JOIN rng r ON f.sst_id = r.sst_id""")  # fmt: skip
def sst_dump(spark, d):
    log = _runs(spark, d)
    o = F.struct("user_key", -F.col("seqno"))
    name = codecs.key_text(F.col("user_key"), F.col("seqno"), F.col("kind"))
    smallest = log.groupBy("sst_id").agg(F.min_by(name, o).alias("smallest"))
    return runs.footers(_blocks(spark, d)).join(smallest, "sst_id").select("sst_id", "data_blocks", "entry_count", "file_bytes", "smallest")


# --- manifest ------------------------------------------------------------------------------

# One edit for each flush; every fourth edit deletes the file of two edits before and every fifth adds a merged one at level 1.
ADDED = """added AS (SELECT sst_id AS edit_idx, 0 AS level, sst_id AS file_id, smallest_key, largest_key, CAST(entries * 32 AS BIGINT) AS file_bytes FROM rng
    UNION ALL SELECT sst_id, 1, sst_id + 1000, smallest_key, largest_key, CAST(entries * 64 AS BIGINT) FROM rng WHERE sst_id % 5 = 0)"""
DELETED = """deleted AS (SELECT sst_id AS edit_idx, 0 AS level, sst_id - 2 AS file_id FROM rng WHERE sst_id % 4 = 0
    UNION ALL SELECT sst_id, 1, sst_id + 995 FROM rng WHERE sst_id % 10 = 0 UNION ALL SELECT sst_id, 3, sst_id FROM rng WHERE sst_id % 7 = 0)"""
LIVE = "live AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM deleted d WHERE d.level = a.level AND d.file_id = a.file_id AND d.edit_idx > a.edit_idx))"


def _edits(spark, d):
    """Edits, added and deleted files, as a store that flushes and sometimes merges would log them."""
    rng = runs.key_ranges(_runs(spark, d))
    i = F.col("sst_id")
    add = lambda level, number, size: [i.alias("edit_idx"), F.lit(level).alias("level"), number.alias("file_id"), F.col("smallest_key"), F.col("largest_key"), (F.col("entries") * size).alias("file_bytes")]
    added = rng.select(*add(0, i, 32)).unionByName(rng.where("sst_id % 5 = 0").select(*add(1, i + 1000, 64)))
    gone = lambda level, number: [i.alias("edit_idx"), F.lit(level).alias("level"), number.alias("file_id")]
    deleted = rng.where("sst_id % 4 = 0").select(*gone(0, i - 2)).unionByName(rng.where("sst_id % 10 = 0").select(*gone(1, i + 995))).unionByName(rng.where("sst_id % 7 = 0").select(*gone(3, i)))
    edits = rng.select(i.alias("edit_idx"), F.when(i % 3 != 0, i + 1).alias("next_file_id"), F.when(i % 2 == 0, F.col("max_seqno")).alias("last_sequence"), F.lit(None).cast("bigint").alias("log_number"))
    return edits, added, deleted


@query(LOG, RUNS, RANGES, sql="""SELECT sst_id AS edit_idx, CASE WHEN sst_id % 3 <> 0 THEN sst_id + 1 END AS next_file_id,
    CASE WHEN sst_id % 2 = 0 THEN max_seqno END AS last_sequence, CAST(NULL AS BIGINT) AS log_number FROM rng""")  # fmt: skip
def manifest_edits(spark, d):
    return _edits(spark, d)[0]


@query(LOG, RUNS, RANGES, """e AS (SELECT sst_id AS edit_idx, CASE WHEN sst_id % 3 <> 0 THEN sst_id + 1 END AS a, CASE WHEN sst_id % 2 = 0 THEN max_seqno END AS b FROM rng)""",
    sql="""SELECT arg_max(a, edit_idx) FILTER (WHERE a IS NOT NULL) AS next_file_id, arg_max(b, edit_idx) FILTER (WHERE b IS NOT NULL) AS last_sequence,
    CAST(NULL AS BIGINT) AS log_number FROM e""")  # fmt: skip
def manifest_counters(spark, d):
    return manifest.counters(_edits(spark, d)[0])


@query(LOG, RUNS, RANGES, ADDED, DELETED, LIVE, sql="""SELECT level, file_id, edit_idx, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level > 0 THEN smallest_key END, edit_idx, file_id) AS ordinal FROM live""")
def manifest_live_files(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.version(manifest.live_files(added, deleted)).select("level", "file_id", "edit_idx", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(LOG, RUNS, RANGES, ADDED, DELETED, sql="""SELECT level, file_id FROM added a WHERE edit_idx <= 8 AND NOT EXISTS
    (SELECT 1 FROM deleted d WHERE d.edit_idx <= 8 AND d.level = a.level AND d.file_id = a.file_id AND d.edit_idx > a.edit_idx)""")  # fmt: skip
def manifest_version_at(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.live_files(added, deleted, 8).select("level", "file_id")


@query(LOG, RUNS, RANGES, ADDED, DELETED, LIVE, sql="SELECT level, count(*) AS files, CAST(sum(file_bytes) AS BIGINT) AS bytes FROM live GROUP BY level")
def manifest_level_summary(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.level_summary(manifest.live_files(added, deleted))


@query(LOG, RUNS, RANGES, ADDED, DELETED, LIVE, sql="SELECT max(level) + 1 AS levels FROM live")
def manifest_level_count(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.level_count(manifest.live_files(added, deleted))


@query(LOG, RUNS, RANGES, """steps AS (SELECT sst_id // 2 AS file_id, sst_id AS edit_idx, 0 AS step, 1 AS d FROM rng
    UNION ALL SELECT sst_id // 2, sst_id, 1, -1 FROM rng WHERE sst_id % 6 = 0)""",
    sql="SELECT file_id, edit_idx FROM (SELECT *, lag(d) OVER (PARTITION BY file_id ORDER BY edit_idx, step) AS before FROM steps) WHERE d = 1 AND before = 1")
def manifest_duplicate_adds(spark, d):
    rng = runs.key_ranges(_runs(spark, d))
    pair = rng.select(F.expr("sst_id div 2").alias("file_id"), F.col("sst_id").alias("edit_idx"))
    return manifest.duplicate_adds(pair, pair.where("edit_idx % 6 = 0"))


LISTING = """lst AS (SELECT printf('%020d.sst', sst_id) AS name, sst_id AS file_id FROM rng WHERE sst_id % 6 <> 1
    UNION ALL SELECT printf('%020d.sst', sst_id + 500), sst_id + 500 FROM rng WHERE sst_id % 3 = 0
    UNION ALL SELECT printf('%06d.sst', sst_id), NULL FROM rng)"""


def _listing(spark, d):
    rng = runs.key_ranges(_runs(spark, d))
    name = lambda n: manifest.file_name(n).alias("name")
    i = F.col("sst_id")
    return rng.where("sst_id % 6 <> 1").select(name(i)).unionByName(rng.where("sst_id % 3 = 0").select(name(i + 500))).unionByName(rng.select(F.format_string("%06d.sst", i).alias("name")))


@query(LOG, RUNS, RANGES, ADDED, DELETED, LIVE, LISTING, sql="SELECT name, file_id FROM lst WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM live)")
def orphan_files(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.orphans(_listing(spark, d), manifest.live_files(added, deleted))


@query(LOG, RUNS, RANGES, ADDED, DELETED, LIVE, LISTING, sql="SELECT level, file_id FROM live WHERE file_id NOT IN (SELECT file_id FROM lst WHERE file_id IS NOT NULL)")
def missing_files(spark, d):
    _, added, deleted = _edits(spark, d)
    return manifest.missing(_listing(spark, d), manifest.live_files(added, deleted)).select("level", "file_id")


@query(sql="SELECT o_orderkey AS file_id, printf('%020d.sst', o_orderkey) AS name, o_orderkey AS parsed, CAST(NULL AS BIGINT) AS parsed_short FROM orders")
def file_name_roundtrip(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    named = o.withColumn("name", manifest.file_name(F.col("file_id")))
    return named.select("file_id", "name", manifest.parse_file_name(F.col("name")).alias("parsed"), manifest.parse_file_name(F.concat(F.col("file_id").cast("string"), F.lit(".sst"))).alias("parsed_short"))


@query(LOG, RUNS, "m AS (SELECT DISTINCT CASE WHEN sst_id % 2 = 0 THEN printf('MANIFEST-%06d', sst_id * 3) ELSE 'MANIFEST-x' END AS name FROM runs)",
    sql="SELECT coalesce(max(TRY_CAST(substr(name, 10) AS BIGINT)), 0) + 1 AS next_id FROM m")
def manifest_next_id(spark, d):
    i = F.col("sst_id")
    return manifest.next_manifest_id(_runs(spark, d).select(F.when(i % 2 == 0, F.format_string("MANIFEST-%06d", i * 3)).otherwise("MANIFEST-x").alias("name")).distinct())


# --- compaction and verification -----------------------------------------------------------


@query(LOG, TOP, sql="SELECT user_key, kind, value, seqno FROM top WHERE rn = 1 AND kind = 1")
def compact_full(spark, d):
    return runs.compact(_runs(spark, d))


@query(LOG, RUNS, sql="""SELECT user_key, kind, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn
    FROM runs WHERE sst_id BETWEEN 2 AND 5) WHERE rn = 1""")  # fmt: skip
def compact_partial(spark, d):
    return runs.compact(_runs(spark, d), F.col("sst_id").between(2, 5), oldest_included=False)


@query(LOG, RUNS, sql="""SELECT user_key, kind, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_key, CASE WHEN seqno <= 2000 THEN 0 WHEN seqno <= 7000 THEN 1 ELSE 2 END
    ORDER BY seqno DESC) AS rn FROM runs) WHERE rn = 1""")  # fmt: skip
def compact_with_snapshots(spark, d):
    return runs.compact(_runs(spark, d), snapshots=(2000, 7000))


@query(LOG, TOP, sql="""SELECT CAST(sum(n) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN rn = 1 AND kind = 1 THEN n END) AS BIGINT) AS live_bytes,
    CAST(sum(n) AS DOUBLE) / CAST(sum(CASE WHEN rn = 1 AND kind = 1 THEN n END) AS DOUBLE) AS ratio FROM (SELECT *, 17 + strlen(user_key) + coalesce(strlen(value), 0) AS n FROM top)""")  # fmt: skip
def space_amplification(spark, d):
    return runs.space_amplification(B.events_log(spark, d))


ACKED = "acked AS (SELECT * FROM log WHERE seqno <= (SELECT max(seqno) FROM log) * 9 // 10)"


@query(LOG, ACKED, """pend AS (SELECT * FROM log WHERE seqno > (SELECT max(seqno) FROM log) * 9 // 10)""",
    """real AS (SELECT user_key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn FROM log
        WHERE seqno <= (SELECT max(seqno) FROM log) * 9 // 10 OR CAST(user_key AS BIGINT) % 3 = 0) WHERE rn = 1 AND kind = 1 AND CAST(user_key AS BIGINT) % 11 <> 5)""",
    """base AS (SELECT user_key, arg_max(kind, seqno) AS k, arg_max(coalesce(value, ''), seqno) AS v FROM acked GROUP BY user_key)""",
    """alt AS (SELECT user_key, arg_max(kind, seqno) AS k, arg_max(coalesce(value, ''), seqno) AS v FROM log GROUP BY user_key)""",
    sql="""SELECT a.user_key, r.user_key IS NOT NULL AS present, r.value FROM alt a LEFT JOIN base b ON a.user_key = b.user_key LEFT JOIN real r ON a.user_key = r.user_key
    WHERE NOT (coalesce(CASE WHEN b.k = 1 THEN b.v END, '<none>') = coalesce(r.value, '<none>') OR coalesce(CASE WHEN a.k = 1 THEN a.v END, '<none>') = coalesce(r.value, '<none>'))""")  # fmt: skip
def oracle_verify(spark, d):
    """A database that applied the pending tail for some keys and lost others: only the lost ones are mismatches."""
    log = B.events_log(spark, d)
    last = log.agg(F.max("seqno")).first()[0] or 0
    cut = last * 9 // 10
    number = F.col("user_key").cast("bigint")
    actual = reads.latest(log.where((F.col("seqno") <= cut) | (number % 3 == 0))).where(number % 11 != 5)
    return verify.verify(actual, log.where(F.col("seqno") <= cut), log.where(F.col("seqno") > cut))


@query("""ev AS (SELECT event_id // 3 AS op_id, event_id AS ord, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_id % 3 = 2 AND event_id % 5 <> 0 THEN 'ack' ELSE 'start' END AS event_kind FROM events)""",
    sql="""SELECT op_id, arg_max(event_kind, ord) AS last_event, count(*) AS events, CASE arg_max(event_kind, ord) WHEN 'ack' THEN 'acked' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS status FROM ev GROUP BY op_id""")
def op_lifecycle(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "fail").when((i % 3 == 2) & (i % 5 != 0), "ack").otherwise("start")
    return verify.lifecycle(B.table(spark, d, "events").select(F.expr("event_id div 3").alias("op_id"), i.alias("ord"), kind.alias("event_kind")))


# --- codecs --------------------------------------------------------------------------------


@query(LOG, sql="SELECT seqno, hex(encode(user_key)) || printf('%016X', seqno) || printf('%02X', kind) AS internal_key FROM log")
def internal_key_hex(spark, d):
    log = B.events_log(spark, d)
    return log.select("seqno", F.hex(codecs.key_column(F.col("user_key"), F.col("seqno"), F.col("kind"))).alias("internal_key"))


@query(LOG, sql="SELECT user_key, seqno, kind FROM log")
def internal_key_decode(spark, d):
    log = B.events_log(spark, d)
    k = log.select(codecs.key_fields(codecs.key_column(F.col("user_key"), F.col("seqno"), F.col("kind"))).alias("k"))
    return k.select(F.col("k.user_key").cast("string").alias("user_key"), F.col("k.seqno").cast("bigint").alias("seqno"), "k.kind")


@query(LOG, """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END)) AS t)""",
    """val AS (SELECT DISTINCT coalesce(value, '') AS v FROM log)""",
    """crc AS (SELECT v, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(v) + 1), lambda i: CAST(ord(substr(v, i, 1)) AS BIGINT))),
        lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), 4294967295) AS crc FROM val, tab)""",
    sql="SELECT seqno, CAST(crc AS BIGINT) AS crc32c FROM log JOIN crc ON coalesce(value, '') = v")
def crc32c(spark, d):
    return B.events_log(spark, d).select("seqno", codecs.crc32c_column(F.coalesce(F.col("value"), F.lit("")).cast("binary")).alias("crc32c"))


@query(LOG, BATCHED, sql="SELECT batch_id, CAST(op_idx AS INTEGER) AS op_idx, user_key, kind, value FROM bat")
def batch_roundtrip(spark, d):
    """Batches encoded in the JVM and decoded by the sequential decoder."""
    encoded = changelog.collect_batches(B.with_batches(B.events_log(spark, d))).select("batch_id", codecs.batch_column(F.col("ops")).alias("payload"))

    def decode(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(b, i, k.decode(), kind, None if v is None else v.decode()) for b, data in zip(pdf["batch_id"], pdf["payload"]) for i, (kind, k, v) in enumerate(codecs.decode_batch(bytes(data)))]
            yield pd.DataFrame(rows, columns=["batch_id", "op_idx", "user_key", "kind", "value"])

    return encoded.mapInPandas(decode, "batch_id bigint, op_idx int, user_key string, kind int, value string")


@query(LOG, RUNS, RANGES, sql="SELECT sst_id AS edit_idx, sst_id + 1 AS next_file_id, max_seqno AS last_sequence, smallest_key, smallest_seqno, largest_key, largest_seqno FROM rng")
def edit_roundtrip(spark, d):
    rng = runs.key_ranges(_runs(spark, d))

    def through(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                made = {"next_file_id": r.sst_id + 1, "last_sequence": r.max_seqno, "added": [(0, r.sst_id, 1, (r.smallest_key.encode(), r.smallest_seqno, 1), (r.largest_key.encode(), r.largest_seqno, 1))]}
                e = codecs.decode_edit(codecs.encode_edit(made))
                (_, number, _, lo, hi) = e["added"][0]
                rows.append((number, e["next_file_id"], e["last_sequence"], lo[0].decode(), lo[1], hi[0].decode(), hi[1]))
            yield pd.DataFrame(rows, columns=["edit_idx", "next_file_id", "last_sequence", "smallest_key", "smallest_seqno", "largest_key", "largest_seqno"])

    return rng.mapInPandas(through, "edit_idx bigint, next_file_id bigint, last_sequence bigint, smallest_key string, smallest_seqno bigint, largest_key string, largest_seqno bigint")


@query(LOG, RUNS, sql="SELECT sst_id, user_key, seqno, kind, value FROM runs")
def block_roundtrip(spark, d):
    """Every run as a file of blocks, index and footer, and read back."""

    def through(pdf):
        import pandas as pd

        rows = sorted(((k.encode(), int(n), int(kind), None if v is None else v.encode()) for k, n, kind, v in zip(pdf["user_key"], pdf["seqno"], pdf["kind"], pdf["value"])), key=lambda e: (e[0], -e[1]))
        back = codecs.decode_run(codecs.encode_run(rows, BLOCK_TARGET))
        return pd.DataFrame([(pdf["sst_id"].iloc[0], k.decode(), n, kind, None if v is None else v.decode()) for k, n, kind, v in back], columns=["sst_id", "user_key", "seqno", "kind", "value"])

    return _runs(spark, d).select("sst_id", "user_key", "seqno", "kind", "value").groupBy("sst_id").applyInPandas(through, "sst_id bigint, user_key string, seqno bigint, kind int, value string")


WORKLOAD = verify.WorkloadConfig(operations=1000)


def _draw(stream: str, n: int | None, idx: str = "op_idx") -> str:
    """The generator's draw in SQL."""
    p, (a, b) = verify.DRAW_PRIME, verify.DRAW_ROOTS
    x = str((WORKLOAD.seed % p * a + verify.STREAMS[stream]) % p)
    for part in (f"op_id % {p}", idx):
        x = f"((({x} + {part}) % {p} * {a} + 12345) % {p})"
        x = f"((xor({x}, {x} >> 15) % {p} * {b} + 54321) % {p})"
    x = f"(xor({x}, {x} >> 13) % {p})"
    return x if n is None else f"({x} % {n})"


OPS = f"""ops AS (SELECT op_id, CASE WHEN pick < {WORKLOAD.put_pct} THEN 'put' WHEN pick < {WORKLOAD.put_pct + WORKLOAD.delete_pct} THEN 'delete' ELSE 'batch' END AS kind
    FROM (SELECT op_id, {_draw("kind", 100, "0")} AS pick FROM range(1, {WORKLOAD.operations + 1}) t(op_id))),
    sized AS (SELECT *, CASE WHEN kind = 'batch' THEN {_draw("size", 3, "0")} + 2 ELSE 1 END AS items FROM ops),
    items AS (SELECT op_id, kind, unnest(range(items)) AS op_idx FROM sized)"""
DRAWN = f"""drawn AS (SELECT *, printf('key-%04d', CASE WHEN {_draw("hot", 100)} < {WORKLOAD.hot_pct} THEN {_draw("key", WORKLOAD.hot_keys)} ELSE {_draw("key", WORKLOAD.keys)} END) AS key,
        kind = 'delete' OR (kind = 'batch' AND {_draw("item", 100)} < {WORKLOAD.delete_pct}) AS wants_delete FROM items),
    typed AS (SELECT *, CASE WHEN wants_delete AND count(*) FILTER (NOT wants_delete) OVER (PARTITION BY key ORDER BY op_id, op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0
        THEN 2 ELSE 1 END AS op_type FROM drawn)"""


@query(OPS, DRAWN, sql=f"""SELECT op_id, CASE WHEN kind = 'delete' AND op_type = 1 THEN 'put' ELSE kind END AS kind, CAST(op_idx AS INTEGER) AS op_idx, op_type, key,
    CASE WHEN op_type = 1 THEN left(repeat(lpad(CAST({_draw("value", None)} AS VARCHAR), 10, '0'), {-(-WORKLOAD.max_value // 10)}), {_draw("len", WORKLOAD.max_value + 1)}) END AS value FROM typed""")
def workload_mix(spark, d):
    return verify.workload(spark, WORKLOAD)


# --- states, orders, files -----------------------------------------------------------------


@query(LOG, sql="SELECT user_key, arg_max(kind, seqno) = 1 AS present, CASE WHEN arg_max(kind, seqno) = 1 THEN arg_max(coalesce(value, ''), seqno) END AS value FROM log GROUP BY user_key")
def model_state(spark, d):
    return verify.state(B.events_log(spark, d))


@query(LOG, sql="SELECT user_key, min(seqno) AS first_seen FROM log GROUP BY user_key")
def model_keys(spark, d):
    return verify.keys_in_order(B.events_log(spark, d))


@query(LOG, """twice AS (SELECT user_key, (seqno + 1) // 2 AS seqno, kind, value, seqno AS insert_ord FROM log)""",
    sql="SELECT user_key, kind, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC, insert_ord DESC) AS rn FROM twice) WHERE rn = 1")
def kv_insertion_ties(spark, d):
    """Versions that share a key and a number: the one inserted later wins."""
    log = B.events_log(spark, d).withColumn("insert_ord", F.col("seqno")).withColumn("seqno", F.expr("(seqno + 1) div 2"))
    return reads.winners(log, order=reads.by_insertion())


@query("""b AS (SELECT o_orderkey AS batch_id, CAST(o_orderkey % 4 AS BIGINT) AS op_count FROM orders)""",
    sql="""SELECT batch_id, op_count, CAST(coalesce(sum(op_count) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_seqno
    FROM b WHERE op_count > 0""")  # fmt: skip
def empty_batches(spark, d):
    """Empty batches take no number."""
    return changelog.assign_seqnos(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderkey") % 4).alias("op_count")))


@query(LOG, """nxt AS (SELECT seqno AS pos, user_key AS a, kind, lead(user_key) OVER (ORDER BY seqno) AS b, seqno * 7 % 5 AS sa, seqno * 3 % 5 AS sb FROM log)""",
    sql="SELECT pos, CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN sa > sb THEN -1 WHEN sa < sb THEN 1 ELSE 0 END AS INTEGER) AS sign FROM nxt WHERE b IS NOT NULL")
def internal_key_compare(spark, d):
    """Each user key against its predecessor's follower: key ascending, then number descending, kinds not compared."""
    log = B.events_log(spark, d)
    nxt = log.select((F.col("seqno") - 1).alias("pos"), F.col("user_key").alias("b"))
    pairs = log.select(F.col("seqno").alias("pos"), F.col("user_key").alias("a"), "kind").join(nxt, "pos")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            sign = [codecs.compare_keys((a.encode(), pos * 7 % 5, kind), (b.encode(), pos * 3 % 5, 3 - kind)) for pos, a, kind, b in zip(pdf["pos"], pdf["a"], pdf["kind"], pdf["b"])]
            yield pd.DataFrame({"pos": pdf["pos"], "sign": sign})

    return pairs.select("pos", "a", "kind", "b").mapInPandas(run, "pos bigint, sign int")


@query("""h AS (SELECT event_id AS pos, event_id % 11 = 3 AS m, event_id % 13 = 4 AS v, event_id % 17 = 5 AS k, event_id % 19 = 6 AS big, event_id % 7 = 1 AS part, event_id % 5 = 2 AS crc,
        CASE WHEN event_id % 23 = 7 THEN 17 WHEN event_id % 29 = 8 THEN 19 ELSE 18 END AS n FROM events)""",
    sql="""SELECT pos, CASE WHEN n < 18 THEN 'truncated' WHEN n > 18 THEN 'corrupt_record' WHEN m THEN 'bad_magic' WHEN v THEN 'bad_version' WHEN k THEN 'bad_type'
    WHEN big THEN 'too_large' WHEN part THEN 'truncated' WHEN crc THEN 'checksum' ELSE 'ok' END AS status FROM h""")  # fmt: skip
def record_header_status(spark, d):
    """Headers with one or more faults: the first check that fails names the record."""
    e = B.table(spark, d, "events").select(F.col("event_id").alias("pos"))
    hit = lambda n, r: F.col("pos") % n == r
    status = codecs.record_status(
        magic=F.when(hit(11, 3), F.lit(S.MANIFEST_MAGIC)).otherwise(F.lit(S.WAL_MAGIC)),
        version=F.when(hit(13, 4), 9).otherwise(S.FORMAT_VERSION),
        kind=F.when(hit(17, 5), 9).otherwise(S.FULL_RECORD),
        header_bytes=F.when(hit(23, 7), 17).when(hit(29, 8), 19).otherwise(S.RECORD_HEADER),
        length=F.when(hit(19, 6), S.MAX_RECORD_PAYLOAD + 1).otherwise(100),
        payload_bytes=F.when(hit(7, 1), 99).otherwise(S.MAX_RECORD_PAYLOAD + 1),
        stated=F.lit(5), actual=F.when(hit(5, 2), 6).otherwise(5), expected=S.WAL_MAGIC,
    )
    return e.select("pos", status.alias("status"))


FILE_BATCHES = 70
LOGGED = f"""file AS (SELECT batch_id // {FILE_BATCHES} AS file_id, batch_id % {FILE_BATCHES} AS pos, encoded_bytes + 18 AS n FROM siz),
    cut AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS end_offset, pos = max(pos) OVER (PARTITION BY file_id) AS last FROM file),
    seen AS (SELECT file_id, pos, CAST(end_offset - n AS BIGINT) AS start_offset, CASE WHEN last AND file_id % 3 = 1 THEN end_offset - 1 ELSE end_offset END AS end_offset,
        CASE WHEN last AND file_id % 3 = 1 THEN 'truncated' WHEN last AND file_id % 3 = 2 THEN 'checksum' ELSE 'ok' END AS status FROM cut)"""


@query(LOG, BATCHED, SIZES, LOGGED, sql="SELECT * FROM seen")
def wal_file_records(spark, d):
    """Framed log files, a third torn by a byte and a third with a damaged last payload, read back record by record."""
    batches = changelog.collect_batches(B.with_batches(B.events_log(spark, d)))
    payloads = batches.select(F.expr(f"batch_id div {FILE_BATCHES}").alias("file_id"), "batch_id", codecs.batch_column(F.col("ops")).alias("payload"))

    def through(pdf):
        import pandas as pd

        number = int(pdf["file_id"].iloc[0])
        data = b"".join(codecs.encode_record(S.WAL_MAGIC, bytes(x)) for x in pdf.sort_values("batch_id")["payload"])
        if number % 3 == 1:
            data = data[:-1]
        elif number % 3 == 2:
            data = data[:-1] + bytes([data[-1] ^ 1])
        rows = [(number, pos, start, end, status) for pos, start, end, _, status in codecs.read_records(data, S.WAL_MAGIC)]
        return pd.DataFrame(rows, columns=["file_id", "pos", "start_offset", "end_offset", "status"])

    return payloads.groupBy("file_id").applyInPandas(through, "file_id bigint, pos bigint, start_offset bigint, end_offset bigint, status string")


@query(LOG, BATCHED, sql="SELECT batch_id AS op_id, CAST(op_idx AS INTEGER) AS op_idx, kind AS op_type, user_key AS key, value FROM bat")
def ndjson_roundtrip(spark, d):
    """Operations as NDJSON files with base64 fields, read back."""
    log = B.with_batches(B.events_log(spark, d))
    ops = log.select(F.col("batch_id").alias("op_id"), "op_idx", F.col("kind").alias("op_type"), F.col("user_key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    path = files.scratch(spark, "ndjson")
    files.operations_json(ops).write.text(path)
    return files.read_operations(spark, path).select("op_id", "op_idx", "op_type", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


FIRST_BATCHES, THEN_BATCHES = 30, 60


def _filled(spark, d) -> Store:
    """A store that took the events in three appends, flushed two of them, and was opened again."""
    path = files.scratch(spark, "store")
    batches = changelog.collect_batches(B.with_batches(B.events_log(spark, d)))
    store = Store(spark, path)
    store.ingest(batches.where(F.col("batch_id") < FIRST_BATCHES))
    store.flush()
    store.ingest(batches.where(F.col("batch_id").between(FIRST_BATCHES, THEN_BATCHES - 1)))
    store.flush()
    store.ingest(batches.where(F.col("batch_id") >= THEN_BATCHES))
    store.close()
    return Store(spark, path)


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("user_key", "value")})


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1")
def store_scan(spark, d):
    """Two runs and a log, replayed on opening."""
    return _text(_filled(spark, d).scan())


@query(LOG, BATCHED, f"""old AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seqno DESC) AS rn FROM bat WHERE batch_id < {FIRST_BATCHES})""",
    sql="SELECT user_key, value, seqno FROM old WHERE rn = 1 AND kind = 1")
def store_snapshot_after_compaction(spark, d):
    store = _filled(spark, d)
    at = FIRST_BATCHES * B.BATCH_OPS
    store.compact(snapshots=(at,))
    return _text(store.scan(snapshot=at))


@query(LOG, BATCHED, f"""part AS (SELECT CASE WHEN batch_id < {FIRST_BATCHES} THEN 1 WHEN batch_id < {THEN_BATCHES} THEN 2 END AS file_id, * FROM bat)""",
    sql="""SELECT 0 AS level, CAST(file_id AS BIGINT) AS file_id, count(*) AS entries, CAST(sum(17 + strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes,
    min(user_key) AS smallest_key, max(user_key) AS largest_key FROM part WHERE file_id IS NOT NULL GROUP BY file_id""")  # fmt: skip
def store_files(spark, d):
    """What the manifest of that store says."""
    live = _filled(spark, d).live()
    return live.select("level", "file_id", "entries", "bytes", F.col("smallest_key").cast("string").alias("smallest_key"), F.col("largest_key").cast("string").alias("largest_key"))


# --- binary files --------------------------------------------------------------------------

START_KEY = "34"


def _run_files(spark, d) -> tuple[str, DataFrame]:
    """The folder of the events' run files, and a row a file."""
    folder = files.scratch(spark, "runs")
    framed.write_runs(_runs(spark, d), folder, BLOCK_TARGET).write.parquet(f"{folder}/facts")
    return folder, spark.read.parquet(f"{folder}/facts")


@query(LOG, RUNS, KEYS_SQL, sql="""SELECT sst_id, user_key, kind, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY sst_id, user_key ORDER BY seqno DESC) AS rn FROM runs
    WHERE user_key IN (SELECT user_key FROM wanted)) WHERE rn = 1""")  # fmt: skip
def run_get(spark, d):
    """Wanted keys in run files: footer, index and one block are read."""
    return _text(framed.get_from_runs(_run_files(spark, d)[1], wanted(spark)))


@query(LOG, RUNS, sql=f"""SELECT sst_id, CAST(row_number() OVER (PARTITION BY sst_id ORDER BY user_key, seqno DESC) - 1 AS BIGINT) AS position, user_key, seqno, kind, value
    FROM runs WHERE user_key >= '{START_KEY}'""")  # fmt: skip
def run_iter(spark, d):
    """Versions of every run file from a key on, block by block."""
    return _text(framed.read_entries(_run_files(spark, d)[1], START_KEY.encode()))


@query(LOG, RUNS, PACKED, """idx AS (SELECT sst_id, block_idx, last_key, last_seqno, block_bytes, CAST(coalesce(sum(block_bytes) OVER (PARTITION BY sst_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM blk)""",
    """foot AS (SELECT sst_id, CAST(sum(entries) AS BIGINT) AS entry_count, CAST(sum(block_bytes) AS BIGINT) AS index_offset, CAST(sum(25 + strlen(last_key)) + 4 AS BIGINT) AS index_bytes FROM blk GROUP BY sst_id)""",
    sql="SELECT sst_id, entry_count, index_offset, index_bytes, block_idx, block_offset, block_bytes, last_key, last_seqno FROM idx JOIN foot USING (sst_id)")
def run_file_dump(spark, d):
    """Footers and indexes of run files."""
    found = framed.read_index(_run_files(spark, d)[1])
    return found.withColumn("last_key", F.col("last_key").cast("string"))


@query(LOG, RUNS, sql="""SELECT sst_id, CAST(row_number() OVER (PARTITION BY sst_id ORDER BY user_key, seqno DESC) - 1 AS BIGINT) AS position, CASE WHEN kind = 1 THEN 'Put' ELSE 'Delete' END AS kind,
    user_key, seqno, CAST(coalesce(strlen(value), 0) AS BIGINT) AS value_bytes FROM runs""")  # fmt: skip
def run_entries_dump(spark, d):
    return dumps.run_entries(framed.read_entries(_run_files(spark, d)[1]))


def _folder(spark, d) -> str:
    """A folder as a crash leaves it: all runs but the last flushed, the rest in log segments.

    The newest segment and the manifest end in torn records, and a run lies there that no edit names.
    """
    folder, facts = _run_files(spark, d)
    log = framed.LogWriter(spark, f"{folder}/MANIFEST-000001", S.MANIFEST_MAGIC, sync_each=True)
    rows = facts.orderBy("sst_id").collect()  # a row a run
    flushed = rows[:-1]
    log.append(codecs.encode_edit({"next_file_id": 1}))
    for r in flushed:
        ends = (bytes(r["smallest_key"]), r["smallest_seqno"], S.PUT), (bytes(r["largest_key"]), r["largest_seqno"], S.PUT)
        log.append(codecs.encode_edit({"next_file_id": r["sst_id"] + 1, "last_sequence": r["max_seqno"], "added": [(0, r["sst_id"], r["bytes"], *ends)]}))
    log._out.write(bytearray(codecs.encode_record(S.MANIFEST_MAGIC, codecs.encode_edit({"next_file_id": 9}))[:-1]))
    log.close()
    framed.replace_text(spark, f"{folder}/CURRENT", "MANIFEST-000001\n")
    done = max((r["max_seqno"] for r in flushed), default=0)
    left = B.events_log(spark, d).where(F.col("seqno") > done).withColumn("batch_id", F.expr(f"(seqno - {done} - 1) div {B.BATCH_OPS}")).withColumn("op_idx", F.expr(f"int((seqno - {done} - 1) % {B.BATCH_OPS})"))
    payloads = changelog.collect_batches(left).select("batch_id", codecs.batch_column(F.col("ops")).alias("payload"))
    log = None
    for r in payloads.orderBy("batch_id").toLocalIterator():  # one run of operations
        if r["batch_id"] % SEGMENT_BATCHES == 0:
            if log:
                log.close()
            log = framed.LogWriter(spark, f"{folder}/{done + r['batch_id'] * B.BATCH_OPS + 1:020d}.wal")
        log.append(bytes(r["payload"]))
    log.sync()
    log._out.write(bytearray(codecs.encode_record(S.WAL_MAGIC, codecs.encode_batch([(S.PUT, b"0", b"torn")]))[:-1]))
    log.close()
    return folder


SEGMENT_BATCHES = 20
FLUSHED = "fl AS (SELECT * FROM rng WHERE sst_id <= (SELECT max(sst_id) - 1 FROM rng))"


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1")
def folder_recover(spark, d):
    """Manifest, run files and log segments after a crash: torn tails are cut, a run without an edit goes, the rest is read."""
    back = recovery.recover(spark, _folder(spark, d))
    return _text(reads.latest(back.versions, order=reads.by_source()))


@query(LOG, RUNS, RANGES, FLUSHED, sql="""SELECT CAST(0 AS BIGINT) AS edit_idx, 0 AS place, 'next_file_id' AS field, '1' AS value UNION ALL SELECT sst_id, 0, 'next_file_id', CAST(sst_id + 1 AS VARCHAR) FROM fl
    UNION ALL SELECT sst_id, 1, 'last_sequence', CAST(max_seqno AS VARCHAR) FROM fl""")  # fmt: skip
def manifest_file_dump(spark, d):
    """Counters that each edit of a framed manifest sets; its torn last record is left out."""
    folder = _folder(spark, d)
    edits, _ = recovery.read_manifest(spark, f"{folder}/MANIFEST-000001", repair=False)
    return dumps.edit_fields(edits).where("field <> 'add_file'")


@query(LOG, BATCHED, SIZES, LOGGED, sql="""SELECT file_id, pos, status, CASE WHEN status = 'ok' THEN CAST(encoded_bytes AS BIGINT) END AS payload_bytes, CASE WHEN status = 'ok' THEN op_count END AS op_count, CAST(NULL AS VARCHAR) AS error
    FROM seen JOIN siz ON siz.batch_id = seen.file_id * 70 + seen.pos""")  # fmt: skip
def wal_dump_file(spark, d):
    """Framed log files, some damaged, decoded record by record."""
    batches = changelog.collect_batches(B.with_batches(B.events_log(spark, d)))
    payloads = batches.select(F.expr(f"batch_id div {FILE_BATCHES}").alias("file_id"), "batch_id", codecs.batch_column(F.col("ops")).alias("payload"))

    def through(pdf):
        import pandas as pd

        number = int(pdf["file_id"].iloc[0])
        data = b"".join(codecs.encode_record(S.WAL_MAGIC, bytes(x)) for x in pdf.sort_values("batch_id")["payload"])
        data = data[:-1] if number % 3 == 1 else data[:-1] + bytes([data[-1] ^ 1]) if number % 3 == 2 else data
        rows = [(str(number), pos, payload, status) for pos, _, _, payload, status in codecs.read_records(data, S.WAL_MAGIC)]
        return pd.DataFrame(rows, columns=["path", "pos", "payload", "status"])

    found = payloads.groupBy("file_id").applyInPandas(through, "path string, pos bigint, payload binary, status string")
    return dumps.log_records(found, decode=True).select(F.col("path").cast("bigint").alias("file_id"), "pos", "status", "payload_bytes", "op_count", "error")


@query(LOG, TOP, sql="SELECT user_key, value, seqno FROM top WHERE rn = 1 AND kind = 1 AND user_key >= '1' AND user_key < '7' ORDER BY user_key DESC LIMIT 25")
def kv_scan_reverse(spark, d):
    """The last 25 live keys of a range, backwards."""
    return reads.scan_reverse(B.events_log(spark, d), "1", "7", limit=25)


@query(LOG, sql="SELECT count(*) AS entries FROM log")
def model_len(spark, d):
    return verify.entries(B.events_log(spark, d))


def _bytes_sql(stream: str, shortest: int, longest: int) -> str:
    words = f"list_reduce(list_prepend('', list_transform(range({longest // 4 + 1}), lambda i: lpad(upper(to_hex({_draw(stream + '_bytes', None, 'i')})), 8, '0'))), lambda a, b: a || b)"
    return f"left({words}, 2 * ({_draw(stream + '_len', longest - shortest + 1, '0')} + {shortest}))"


PAIRS = 1000


@query(f"ids AS (SELECT op_id FROM range(1, {PAIRS + 1}) t(op_id))", sql=f"SELECT op_id, {_bytes_sql('key', 1, 16)} AS key, {_bytes_sql('value', 0, 64)} AS value FROM ids")
def random_pairs(spark, d):
    """Random keys and values, in hexadecimal digits."""
    return verify.random_pairs(spark, PAIRS, seed=WORKLOAD.seed).select("op_id", F.hex("key").alias("key"), F.hex("value").alias("value"))
