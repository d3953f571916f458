import io
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake import faults, tools
from ledgerlake import schema as S
from ledgerlake.functions import codecs
from ledgerlake.operators import verify
from ledgerlake.operators.changelog import Batch
from ledgerlake.plans import recovery
from ledgerlake.plans.store import Store
from ledgerlake.sources import files, framed


def versions(n, seed=1):
    rng = random.Random(seed)
    made = {(b"k%03d" % rng.randrange(n // 2), s): (1, b"v" * rng.randrange(60)) if rng.random() < 0.8 else (2, None) for s in range(1, n + 1)}
    return sorted(((k, s, kind, v) for (k, s), (kind, v) in made.items()), key=lambda e: (e[0], -e[1]))


@pytest.mark.parametrize("target", [1, 100, 4096])
def test_run_reader_against_all_entries(tmp_path, target):
    entries = versions(300)
    path = str(tmp_path / "r.sst")
    (tmp_path / "r.sst").write_bytes(codecs.encode_run(entries, target))
    run = framed.RunReader(path)
    assert run.entry_count == len(entries) and list(run.cursor()) == entries
    for key in [b"", b"k", b"zz", *{e[0] for e in entries}, b"k001x"]:
        for snapshot in (0, 1, 150, 300, framed.NEWEST):
            want = next(((s, kind, v) for k, s, kind, v in entries if k == key and s <= snapshot), None)
            assert run.get(key, snapshot) == want
            after = [e for e in entries if (e[0], -e[1]) >= (key, -snapshot)]
            assert list(run.cursor().seek(key, snapshot)) == after
    cursor = run.cursor()
    next(cursor)
    assert next(cursor.seek(b"")) == entries[0]
    cursor.close()
    for call in (lambda: next(cursor), lambda: cursor.seek(b""), cursor.close):
        with pytest.raises(E.IteratorClosedError):
            call()
    run.close()
    with pytest.raises(E.ClosedError):
        run.get(b"k001")


def test_damaged_runs(tmp_path):
    data = codecs.encode_run(versions(100), 200)
    path = tmp_path / "r.sst"

    def opened(content):
        path.write_bytes(content)
        return framed.RunReader(str(path))

    for content, error in ((b"", E.CorruptFooterError), (data[:-1], E.CodecError), (data[1:], E.CodecError), (data[: -S.FOOTER - 1] + b"\xff" + data[-S.FOOTER :], E.ChecksumError)):
        with pytest.raises(error):
            opened(content)
    run = opened(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(E.ChecksumError):
        list(run.cursor())
    last = run.index[-1][0][0]
    assert run.get(last)  # the other blocks are whole
    empty = opened(codecs.encode_run([]))
    assert list(empty.cursor()) == [] and empty.get(b"") is None


def test_run_writer_checks():
    out = io.BytesIO()
    with pytest.raises(E.InvalidOptionError):
        codecs.RunWriter(out, 0)
    writer = codecs.RunWriter(out)
    writer.add(b"b", 2, 1, b"")
    for bad in ((b"a", 9, 1, b""), (b"b", 2, 1, b""), (b"b", 3, 1, b"")):
        with pytest.raises(E.KeyOrderError):
            writer.add(*bad)
    writer.add(b"b", 1, 2, None)
    assert writer.close() == len(out.getvalue())
    for call in (writer.close, lambda: writer.add(b"c", 1, 1, b"")):
        with pytest.raises(E.ClosedError):
            call()


def test_log_writer_and_repair(spark, tmp_path):
    path = f"file://{tmp_path}/a.wal"
    log = framed.LogWriter(spark, path)
    payloads = [b"", b"x" * 100, codecs.encode_batch([(1, b"k", b"v")])]
    places = [log.append(p) for p in payloads]
    assert places[0] == (0, S.RECORD_HEADER) and places[2][1] == log.offset
    log.sync()
    log.close()
    with pytest.raises(E.ClosedError):
        log.append(b"")
    with pytest.raises(Exception):
        framed.LogWriter(spark, path)  # is there already
    whole = (tmp_path / "a.wal").read_bytes()
    assert framed.repair_log(spark, path) == len(whole)
    (tmp_path / "torn.wal").write_bytes(whole[:-1])
    assert framed.repair_log(spark, f"file://{tmp_path}/torn.wal") == places[1][1]
    assert (tmp_path / "torn.wal").read_bytes() == whole[: places[1][1]]
    damaged = whole[: S.RECORD_HEADER + 30] + b"?" + whole[S.RECORD_HEADER + 31 :]
    (tmp_path / "bad.wal").write_bytes(damaged)
    with pytest.raises(E.CorruptLogError):
        framed.repair_log(spark, f"file://{tmp_path}/bad.wal")
    assert (tmp_path / "bad.wal").read_bytes() == damaged


def folder(spark, at, torn=b""):
    """One run of sequence numbers 1 and 2, a run without an edit, and two segments of one batch each."""
    at.mkdir()
    run = [(b"a", 1, 1, b"1"), (b"b", 2, 1, b"1")]
    for number in (1, 7):
        (at / f"{number:020d}.sst").write_bytes(codecs.encode_run(run))
    edits = [{"next_file_id": 1}, {"next_file_id": 2, "last_sequence": 2, "added": [(0, 1, 50, (b"a", 1, 1), (b"b", 2, 1))]}]
    (at / "MANIFEST-000001").write_bytes(b"".join(codecs.encode_record(S.MANIFEST_MAGIC, codecs.encode_edit(e)) for e in edits) + torn)
    (at / "CURRENT").write_text("MANIFEST-000001\n")
    record = lambda ops: codecs.encode_record(S.WAL_MAGIC, codecs.encode_batch(ops))
    (at / f"{2:020d}.wal").write_bytes(record([(1, b"b", b"1"), (2, b"a", None)]))
    (at / f"{4:020d}.wal").write_bytes(record([(1, b"c", b""), (1, b"b", b"2")]) + torn)
    return f"file://{at}"


def test_recover(spark, tmp_path):
    torn = codecs.encode_record(S.WAL_MAGIC, b"")[:5]
    path = folder(spark, tmp_path / "db", torn)
    seen = recovery.recover(spark, path, repair=False)
    assert seen.torn == ["MANIFEST-000001", f"{4:020d}.wal"] and (tmp_path / "db" / f"{7:020d}.sst").exists()
    back = recovery.recover(spark, path)
    rows = sorted((bytes(r["user_key"]), r["seqno"], r["kind"]) for r in back.versions.collect())
    assert rows == [(b"a", 1, 1), (b"a", 3, 2), (b"b", 2, 1), (b"b", 5, 1), (b"c", 4, 1)]
    assert back.orphans == [f"{7:020d}.sst"] and not (tmp_path / "db" / f"{7:020d}.sst").exists()
    assert back.counters["next_file_id"] == 2 and back.live.count() == 1
    again = recovery.recover(spark, path)
    assert again.torn == [] and again.orphans == [] and again.versions.count() == 5
    with open(tmp_path / "db" / f"{2:020d}.wal", "ab") as f:
        f.write(torn)
    with pytest.raises(E.CorruptLogError):
        recovery.recover(spark, path)
    (tmp_path / "db" / f"{1:020d}.sst").unlink()
    with pytest.raises(E.MissingFileError):
        recovery.recover(spark, path)
    (tmp_path / "db" / "CURRENT").unlink()
    with pytest.raises(E.NoPointerError):
        recovery.recover(spark, path)


def test_tools(spark, tmp_path, capsys):
    path = folder(spark, tmp_path / "db", codecs.encode_record(S.WAL_MAGIC, b"")[:5])
    assert tools.main(["log", "--decode", f"{path}/{4:020d}.wal"], spark) == 0
    out = capsys.readouterr().out
    assert "record 0: 29 bytes, 2 operations" in out and "record 1: truncated" in out and "1 records, 1 incomplete" in out
    assert tools.main(["run", "--entries", f"{path}/{1:020d}.sst"]) == 0
    out = capsys.readouterr().out
    assert "entries 2, data blocks 1" in out and "[1] Put key=b seqno=2 value=1 bytes" in out
    assert tools.main(["manifest", path], spark) == 0
    out = capsys.readouterr().out
    assert "edit 1: add_file level=0 id=1 size=50 smallest=a/1/Put largest=b/2/Put" in out and "level 0: 1 files, 50 bytes" in out and "edit 2: truncated" in out
    (tmp_path / "db" / "MANIFEST-000001").write_bytes(b"?" * 40)
    assert tools.main(["manifest", path], spark) == 1
    assert tools.main(["run", f"{path}/{4:020d}.wal"]) == 1
    (tmp_path / "new").mkdir()
    assert tools.main(["manifest", f"file://{tmp_path}/new"], spark) == 0


def test_faults_happen_once(spark, tmp_path):
    for name in faults.FAULTS:
        hook = faults.Faults(fault=name)
        s = Store(spark, f"file://{tmp_path}/{name}", hook=hook)
        if name == "wal_sync_error":
            with pytest.raises(E.InjectedFaultError):
                s.put(b"k", b"v")
            assert s.put(b"k", b"v") == 1
            continue
        s.put(b"k", b"v")
        with pytest.raises(E.InjectedFaultError):
            s.flush()
        with pytest.raises(E.FlushFailedError):
            s.put(b"k", b"w")
        s = Store(spark, f"file://{tmp_path}/{name}", hook=hook)
        assert s.flush() == 1 and s.get(b"k") == b"v"
    ended = []
    hook = faults.Faults.from_environment({faults.CRASH_VARIABLE: "wal_after_append"}, ended.append)
    hook("log_synced"), hook("log_appended"), hook("log_appended")
    assert ended == [faults.EXIT_CODE]
    hook.reset()
    hook("log_appended")
    assert len(ended) == 2
    with pytest.raises(E.InvalidOptionError):
        faults.Faults("nowhere")
    assert faults.is_crash("") and not faults.is_crash("wal_sync_error") and faults.is_fault("wal_sync_error")


def test_threads_take_turns(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    threads = [threading.Thread(target=s.put, args=(b"k%d" % i, b"v")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert s.seqno == 4 and sorted(r["seqno"] for r in s.versions().collect()) == [1, 2, 3, 4]


def test_batch(spark, tmp_path):
    key = bytearray(b"k")
    b = Batch().put(key, b"v").delete(b"").put(b"", b"")
    key[0] = 0
    copy = b.clone()
    assert Batch.decode(b.encode()).ops == b.ops == [(1, b"k", b"v"), (2, b"", None), (1, b"", b"")]
    s = Store(spark, f"file://{tmp_path}/db")
    assert s.write(b) == 3 and s.get(b"") == b""
    b.clear()
    assert len(b) == 0 and len(copy) == 3 and s.write(b) == 3


def test_profiles_and_artifacts(spark, tmp_path):
    c = verify.HarnessConfig("db", "out", profile="ci")
    assert (c.cycles, c.seed, c.workload().operations) == (6, 777, 24)
    for wrong in (dict(dbdir=""), dict(profile="x"), dict(put_ratio=61), dict(min_delay_ms=9, max_delay_ms=8), dict(cycles=0), dict(crash_point="x"), dict(hot_key_ratio=101)):
        with pytest.raises(E.InvalidOptionError):
            verify.HarnessConfig(**{"dbdir": "db", "artifact_dir": "out", **wrong})
    text = files.artifact_json({"seed": 777}, [{"kind": "put", "op_id": 1}], [], [], failure=None, last_acked_op_id=1)
    path = f"file://{tmp_path}/crash.json"
    framed.replace_text(spark, path, text)
    framed.replace_text(spark, path, text)
    row = files.read_artifact(spark, path).first()
    assert row["seed"] == 777 and row["last_acked_op_id"] == 1 and "failure" not in row
    framed.replace_text(spark, path, json.dumps({"version": 9}))
    with pytest.raises(E.StoreError):
        files.read_artifact(spark, path)


def test_random_pairs(spark):
    got = verify.random_pairs(spark, 2000, 5, 9).agg(F.min(F.octet_length("key")), F.max(F.octet_length("key")), F.min(F.octet_length("value")), F.max(F.octet_length("value"))).first()
    assert tuple(got) == (1, 5, 0, 9)
    with pytest.raises(E.InvalidOptionError):
        verify.random_pairs(spark, 1, 0)
