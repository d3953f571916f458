import os

import pytest
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import schema as S
from ledgerlake.functions import codecs
from ledgerlake.plans.store import Options, Store
from ledgerlake.sources import files
from ledgerlake.streaming.ingest import ingest_stream, latest_stream, live


def test_edge_values_and_errors(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    assert s.write([]) == 0 and s.write(None) == 0
    s.write([(1, b"name", b"alice"), (1, b"", b"value"), (1, b"key", b""), (1, b"\0\1\2", b"\xff\xfe\xfd")])
    assert [s.get(k) for k in (b"name", b"", b"key", b"\0\1\2")] == [b"alice", b"value", b"", b"\xff\xfe\xfd"]
    assert s.delete(b"nothing") == 5
    with pytest.raises(E.KeyNotFoundError):
        s.get(b"nothing")
    with pytest.raises(E.CancelledError):
        s.write([(1, b"a", b"b")], cancelled=True)
    with pytest.raises(E.UnknownOpError):
        s.write([(3, b"a", b"b")])
    s.close()
    for call in (s.close, lambda: s.get(b"a"), lambda: s.put(b"a", b"b")):
        with pytest.raises(E.ClosedError):
            call()
    with pytest.raises(E.InvalidOptionError):
        Options(flush_bytes=-1)


def test_flush_reopen_compact(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    s = Store(spark, path)
    s.write([(1, b"a", b"1"), (1, b"b", b"1"), (1, b"c", b"1")])
    assert s.flush() == 1 and s.flush() is None
    at = s.snapshot()
    s.write([(1, b"a", b"2"), (2, b"b", None)])
    assert s.flush() == 2
    s.put(b"d", b"mem")
    s.close()
    s = Store(spark, path)
    assert s.seqno == 6 and s.flushed == 5
    rows = lambda df: [(bytes(r["user_key"]), bytes(r["value"])) for r in df.collect()]
    assert rows(s.scan()) == [(b"a", b"2"), (b"c", b"1"), (b"d", b"mem")]
    assert rows(s.scan(b"b", b"d")) == [(b"c", b"1")] and rows(s.scan(limit=1)) == [(b"a", b"2")]
    assert rows(s.scan(snapshot=at)) == [(b"a", b"1"), (b"b", b"1"), (b"c", b"1")]
    assert s.get(b"b", at) == b"1"
    assert s.stats().count() == 2
    assert s.compact(snapshots=(at,)) == 3
    assert s.get(b"b", at) == b"1" and s.live().count() == 1
    assert s.compact() == 4
    assert rows(s.scan()) == [(b"a", b"2"), (b"c", b"1"), (b"d", b"mem")]
    assert Store(spark, path).seqno == 6


@pytest.mark.parametrize("point, visible", [("run_written", False), ("edit_written", False), ("pointer_swapped", True)])
def test_a_stopped_commit_is_seen_whole_or_not(spark, tmp_path, point, visible):
    path = f"file://{tmp_path}/db"

    def stop(at):
        if armed and at == point:
            raise RuntimeError(at)

    armed = False
    s = Store(spark, path, hook=stop)
    s.put(b"k", b"v")
    armed = True
    with pytest.raises(RuntimeError):
        s.flush()
    with pytest.raises(E.FlushFailedError):
        s.put(b"x", b"y")
    armed = False
    s = Store(spark, path)
    assert s.get(b"k") == b"v" and s.seqno == 1
    assert s.live().count() == int(visible)
    assert len(os.listdir(tmp_path / "db" / "runs")) == int(visible)


def test_second_writer_fences_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    opened = []

    def open_another(point):
        if armed and point == "run_written":
            opened.append(Store(spark, path))

    armed = False
    first = Store(spark, path, hook=open_another)
    first.put(b"k", b"v")
    armed = True
    with pytest.raises(E.FencedError):
        first.flush()
    with pytest.raises(E.FlushFailedError):
        first.ingest(spark.createDataFrame([(0, [{"op_type": 1, "key": b"a", "value": b"b"}])], S.BATCH))
    second = opened[0]
    assert second.get(b"k") == b"v" and second.flush() == 1 and second.segments() == []
    reader = Store(spark, path, read_only=True)
    second.put(b"k", b"w")
    assert reader.get(b"k") == b"w"
    second.flush()
    assert reader.get(b"k") == b"w" and Store(spark, path).seqno == 2
    for call in (reader.flush, reader.compact, lambda: reader.put(b"a", b"b")):
        with pytest.raises(E.ReadOnlyError):
            call()


def test_ingest_checks_kinds_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/db"

    def stop(point):
        if armed and point == "log_appended":
            raise RuntimeError(point)

    armed = False
    s = Store(spark, path, hook=stop)
    frame = lambda kind: spark.createDataFrame([(0, [{"op_type": kind, "key": b"a", "value": b"b"}]), (1, [])], S.BATCH)
    for kind in (7, None):
        with pytest.raises(E.UnknownOpError):
            s.ingest(frame(kind))
    armed = True
    with pytest.raises(RuntimeError):
        s.ingest(frame(1), micro_batch=3)
    s = Store(spark, path)
    assert s.seqno == 1 and s.ingest(frame(1), micro_batch=3) == 1
    s.flush()
    assert s.ingest(frame(1), micro_batch=3) == 1 and s.ingest(frame(1), micro_batch=4) == 2


def test_segment_names_are_no_micro_batches(spark, tmp_path, monkeypatch):
    from ledgerlake.plans import store

    class Name:
        hex = "b" * 32

    monkeypatch.setattr(store.uuid, "uuid4", lambda: Name)
    s = Store(spark, f"file://{tmp_path}/db")
    s.put(b"a", b"1")
    assert s.flush() == 1 and s.segments() == [] and not s._exists("stream-commits")


def test_compaction_keeps_open_snapshots(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.put(b"a", b"1")
    at = s.snapshot()
    s.flush()
    s.write([(2, b"a", None)])
    s.flush()
    s.compact()
    assert s.get(b"a", at) == b"1"
    s.release(at)
    s.compact()
    with pytest.raises(E.KeyNotFoundError):
        s.get(b"a", at)


def test_auto_flush_and_missing_file(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    s = Store(spark, path, Options(flush_bytes=100))
    s.put(b"a", b"x" * 20)
    assert s.flushed == 0
    s.put(b"b", b"x" * 60)
    assert s.flushed == 2 and s.live().count() == 1
    import shutil

    shutil.rmtree(tmp_path / "db" / "runs")
    with pytest.raises(E.MissingFileError):
        Store(spark, path)


def test_log_files(spark, tmp_path):
    records = [codecs.encode_record(S.WAL_MAGIC, codecs.encode_batch([(1, b"key-%03d" % i, b"value-%03d" % i)])) for i in range(1, 6)]
    (tmp_path / "torn.wal").write_bytes(b"".join(records)[:-1])
    log = files.read_log(spark, str(tmp_path / "torn.wal"))
    assert [r["status"] for r in log.orderBy("pos").collect()] == ["ok"] * 4 + ["truncated"]
    ops = files.read_batches(log).select(F.explode("ops").alias("o")).select("o.key").collect()
    assert sorted(bytes(r["key"]) for r in ops) == [b"key-%03d" % i for i in range(1, 5)]
    edit = codecs.encode_edit({"next_file_id": 4, "deleted": [(0, 1)], "added": [(0, 3, 9, (b"a", 1, 1), (b"b", 2, 2))]})
    (tmp_path / "m").write_bytes(codecs.encode_record(S.MANIFEST_MAGIC, edit))
    row = files.read_edits(files.read_log(spark, str(tmp_path / "m"), S.MANIFEST_MAGIC)).first()
    assert (row["next_file_id"], row["last_sequence"], row["added"][0]["file_id"], row["deleted"][0]["level"]) == (4, None, 3, 0)
    (tmp_path / f"{5:020d}.sst").write_bytes(codecs.encode_run([(b"k", 2, 2, None), (b"k", 1, 1, b"v")]))
    got = files.read_runs(spark, str(tmp_path / f"{5:020d}.sst")).collect()
    assert [(r["file_id"], r["seqno"], r["kind"]) for r in got] == [(5, 2, 2), (5, 1, 1)]
    assert {r["name"] for r in files.list_names(spark, str(tmp_path), "*.sst").collect()} == {f"{5:020d}.sst"}


def test_ndjson(spark, tmp_path):
    rows = [(7, 0, 1, bytearray(b"\0\n\xff"), bytearray(b"\1\2")), (7, 1, 2, bytearray(b"\n\x0b"), None), (8, 0, 1, bytearray(b"k"), bytearray(b"v"))]
    ops = spark.createDataFrame(rows, "op_id bigint, op_idx int, op_type int, key binary, value binary")
    files.operations_json(ops).coalesce(1).write.text(str(tmp_path / "ops"))
    back = files.read_operations(spark, str(tmp_path / "ops")).orderBy("op_id", "op_idx").collect()
    assert [tuple(r) for r in back] == rows
    for line in ('{"kind":"put","op_id":1,"key_b64":"%%%not-base64%%%"}', '{"kind":"peek","op_id":1,"key_b64":"aa=="}'):
        (tmp_path / "bad.json").write_text(line)
        with pytest.raises(Exception):
            files.read_operations(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "ev.json").write_text('{"cycle":1,"event":{"kind":"ready"}}\n{"cycle":1,"event":{"kind":"ack"}}\n')
    assert sorted((r["event_kind"], r["op_id"]) for r in files.read_events(spark, str(tmp_path / "ev.json")).collect()) == [("ack", 0), ("ready", None)]


def test_streams(spark, tmp_path):
    log = spark.range(1, 1001).selectExpr("cast(id % 17 as string) user_key", "id seqno", "if(id % 5 = 0, 2, 1) kind", "if(id % 5 = 0, null, cast(id as string)) value")
    log.where("seqno > 500").write.parquet(str(tmp_path / "in"))
    log.where("seqno <= 500").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from ledgerlake.operators import reads

    assert sorted(map(tuple, live(spark.table("newest")).select("user_key", "value", "seqno").collect())) == sorted(map(tuple, reads.latest(log).collect()))
    batches = spark.createDataFrame([(i, [{"op_type": 1, "key": b"k%d" % (i % 3), "value": b"%d" % i}]) for i in range(6)], S.BATCH)
    batches.coalesce(1).write.parquet(str(tmp_path / "b"))
    store = Store(spark, f"file://{tmp_path}/db")
    q = ingest_stream(spark.readStream.schema(S.BATCH).parquet(str(tmp_path / "b")), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert store.get(b"k2") == b"5" and store.seqno == 6 and store.live().count() == 1
