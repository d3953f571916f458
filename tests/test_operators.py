import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import errors as E
from ledgerlake.operators import changelog, manifest, reads, records, runs, verify

LOG = "user_key string, seqno bigint, kind int, value string"


def log(spark, *rows, extra=""):
    return spark.createDataFrame([(*r, None)[: 4 + extra.count(",")] if len(r) < 4 else r for r in rows], LOG + extra)


def test_visibility_table(spark):
    kv = log(spark, ("a", 1, 1, "a1"), ("b", 2, 1, "b2"), ("a", 3, 1, "a3"), ("b", 4, 2, None), ("c", 5, 1, "c5"))
    want = {
        ("a", 0): ("absent", None), ("a", 1): ("found", "a1"), ("a", 2): ("found", "a1"), ("a", 3): ("found", "a3"), ("a", 100): ("found", "a3"),
        ("b", 1): ("absent", None), ("b", 2): ("found", "b2"), ("b", 3): ("found", "b2"), ("b", 4): ("deleted", None), ("b", 100): ("deleted", None),
        ("c", 4): ("absent", None), ("c", 5): ("found", "c5"),
    }
    got = reads.get_as_of(kv, spark.createDataFrame(list(want), "user_key string, snapshot bigint")).collect()
    assert {(r["user_key"], r["snapshot"]): (r["status"], r["value"]) for r in got} == want
    for (key, at), (status, value) in want.items():
        row = reads.get_many(kv, spark.createDataFrame([(key,)], "user_key string"), at).first()
        assert (row["status"], row["value"]) == (status, value)


def test_versions_out_of_order_and_resurrection(spark):
    kv = log(spark, ("ver", 3, 1, "v3"), ("ver", 1, 1, "v1"), ("ver", 5, 1, "v5"), ("k", 1, 1, "first"), ("k", 3, 2, None), ("k", 5, 1, "back"), ("e", 2, 1, ""))
    at = lambda s: {r["user_key"]: r["value"] for r in reads.latest(kv, s).collect()}
    assert at(100) == {"ver": "v5", "k": "back", "e": ""} and at(4) == {"ver": "v3", "e": ""} and at(2) == {"ver": "v1", "k": "first", "e": ""} and at(0) == {}
    assert [(r["user_key"], r["seqno"]) for r in reads.resurrected(kv).collect()] == [("k", 5)]
    assert [r["user_key"] for r in reads.tombstones(kv, 4).collect()] == ["k"]


def test_equal_seqno_last_insert_wins(spark):
    rows = [("k", 5, 1, "val", 1), ("k", 5, 2, None, 2), ("d", 1, 1, "first", 1), ("d", 1, 1, "second", 2)]
    kv = spark.createDataFrame(rows, LOG + ", insert_ord bigint")
    got = {r["user_key"]: (r["kind"], r["value"]) for r in reads.winners(kv, order=reads.by_insertion()).collect()}
    assert got == {"k": (2, None), "d": (1, "second")}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("foo", 1, 1, "old", 1), ("foo", 2, 1, "new", 9)], {"foo": "new"}),
        ([("doomed", 1, 1, "alive", 1), ("doomed", 2, 2, None, 9)], {}),
        ([("foo", 1, 1, "v1", 1), ("foo", 2, 1, "v2", 2)], {"foo": "v2"}),
        ([("a", 1, 1, "from-sst", 1), ("b", 2, 1, "from-mem", 9)], {"a": "from-sst", "b": "from-mem"}),
        ([("x", 9, 1, "low source", 1), ("x", 2, 1, "high source", 2)], {"x": "high source"}),
    ],
)
def test_sources_shadow(spark, rows, want):
    kv = spark.createDataFrame(rows, LOG + ", source_rank bigint")
    assert {r["user_key"]: r["value"] for r in reads.latest(kv, order=reads.by_source()).collect()} == want


def test_seek_and_scans(spark):
    kv = log(spark, ("a", 1, 1, "x"), ("c", 2, 1, "y"), ("c", 3, 2, None), ("d", 4, 1, "z"))
    got = {r["target"]: (r["user_key"], r["seqno"]) for r in reads.seek(kv, spark.createDataFrame([("",), ("b",), ("d",), ("e",)], "target string")).collect()}
    assert got == {"": ("a", 1), "b": ("c", 3), "d": ("d", 4), "e": (None, None)}
    assert [r["user_key"] for r in reads.scan_range(kv, "a", "d").collect()] == ["a"]
    assert [r["user_key"] for r in reads.scan_range(kv, limit=1).collect()] == ["a"]
    assert [r["user_key"] for r in reads.scan_prefix(kv, "d").collect()] == ["d"]


def test_long_key_lists_lose_no_row(spark):
    at = [3 * i for i in range(3000)]
    key = lambda i: f"k{i:06d}"
    kv = spark.createDataFrame([(key(i), n + 1, 1 + n % 2, None) for n, i in enumerate(at)], LOG.split(", source")[0])
    asked = [*range(10_500), 10**6]
    keys = spark.createDataFrame([(key(i),) for i in asked], "user_key string")
    n_of = lambda i: -(-i // 3) if i <= at[-1] else None
    got = {r["target"]: tuple(r)[1:] for r in reads.seek(kv, keys.withColumnRenamed("user_key", "target")).collect()}
    assert got == {key(i): (None,) * 3 if (n := n_of(i)) is None else (key(at[n]), n + 1, 1 + n % 2) for i in asked}
    index = spark.createDataFrame([(s, b, key(at[-1] * (b + 1) // 10 + s)) for s in (0, 1) for b in range(10)], "sst_id bigint, block_idx bigint, last_key string")
    got = {(r["sst_id"], r["wanted"]): r["block_idx"] for r in runs.find_blocks(index, keys).collect()}
    lasts = {s: [at[-1] * (b + 1) // 10 + s for b in range(10)] for s in (0, 1)}
    assert got == {(s, key(i)): next(b for b in range(10) if lasts[s][b] >= i) for s in (0, 1) for i in asked if i <= lasts[s][-1]}
    ranges = spark.createDataFrame([(0, key(0), key(10_400))], "sst_id bigint, smallest_key string, largest_key string")
    assert runs.prune(ranges, keys).count() == 10_401


def test_random_log_against_a_dict(spark):
    rng = random.Random(5)
    rows, model, sample = [], {}, {}
    for n in range(1, 2001):
        key = f"k{rng.randrange(100)}"
        put = rng.random() < 0.7
        rows.append((key, n, 1 if put else 2, f"v{n}" if put else None))
        model[key] = f"v{n}" if put else None
        if n == 900:
            sample = dict(model)
    kv = log(spark, *rows).repartition(5)
    for s, state in ((None, model), (900, sample)):
        assert {r["user_key"]: r["value"] for r in reads.latest(kv, s).collect()} == {k: v for k, v in state.items() if v is not None}


def test_seqnos(spark):
    op = lambda t, k: {"op_type": t, "key": k, "value": b"v" if t == 1 else None}
    from ledgerlake import schema as S

    batches = spark.createDataFrame([(0, [op(1, b"a")]), (1, [op(1, b"b")]), (2, [op(2, b"a")]), (3, []), (4, [op(1, b"c"), op(1, b"d"), op(2, b"b")])], S.BATCH)
    got = changelog.explode_batches(batches).orderBy("seqno").collect()
    assert [(bytes(r["user_key"]), r["seqno"], r["kind"]) for r in got] == [(b"a", 1, 1), (b"b", 2, 1), (b"a", 3, 2), (b"c", 4, 1), (b"d", 5, 1), (b"b", 6, 2)]


def test_prefix_sum_over_chunks(spark):
    df = spark.range(1000).withColumn("n", F.col("id") % 7)
    got = [r["s"] for r in changelog.prefix_sum(df, "id", "n", "s", chunk=64).orderBy("id").collect()]
    want, total = [], 0
    for i in range(1000):
        want.append(total)
        total += i % 7
    assert got == want


def test_valid_prefix_and_tail(spark):
    rec = lambda *s: spark.createDataFrame(list(enumerate(s)), "pos bigint, status string")
    assert records.valid_prefix(rec("ok", "ok", "truncated")).count() == 2
    assert records.valid_prefix(rec("ok", "ok")).count() == 2
    assert records.check_tail(rec("ok", "truncated")) == "torn" and records.check_tail(rec("ok")) == "clean"
    for bad in (rec("ok", "checksum", "ok"), rec("truncated", "ok"), rec("ok", "checksum")):
        with pytest.raises(E.CorruptLogError):
            records.check_tail(bad)


ADD, DEL = "edit_idx bigint, level int, file_id bigint, smallest_key string", "edit_idx bigint, level int, file_id bigint"


@pytest.mark.parametrize(
    "added, deleted, want",
    [
        ([(1, 0, 42, "a")], [(2, 0, 42)], []),
        ([], [(1, 0, 999)], []),
        ([(1, 0, 3, "c"), (2, 0, 1, "a"), (3, 0, 2, "b")], [], [(0, 3), (0, 1), (0, 2)]),
        ([(1, 1, 30, "c"), (1, 1, 10, "a"), (1, 1, 20, "b")], [], [(1, 10), (1, 20), (1, 30)]),
        ([(1, 1, i, str(i)) for i in (1, 2, 3)], [(2, 1, 2)], [(1, 1), (1, 3)]),
        ([(1, 1, i, str(i)) for i in (1, 2, 3)], [(2, 1, 999), (2, 99, 1)], [(1, 1), (1, 2), (1, 3)]),
        ([(1, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 3, "ab")], [(2, 1, 1)], [(1, 3), (1, 2)]),
        ([(5, 0, 7, "a")], [(5, 0, 7)], [(0, 7)]),
    ],
)
def test_live_files(spark, added, deleted, want):
    a, d = spark.createDataFrame(added, ADD), spark.createDataFrame(deleted, DEL)
    got = manifest.version(manifest.live_files(a, d)).orderBy("level", "ordinal").collect()
    assert [(r["level"], r["file_id"]) for r in got] == want


def test_manifest_checks(spark):
    edits = spark.createDataFrame([(1, 1, None, None), (2, 5, 99, None), (3, 3, None, None)], "edit_idx bigint, next_file_id bigint, last_sequence bigint, log_number bigint")
    none = spark.createDataFrame([], DEL)
    one = spark.createDataFrame([(1, 0, 42, "a")], ADD)
    assert manifest.check_replay(edits, one, none) == {"next_file_id": 3, "last_sequence": 99, "log_number": None}
    with pytest.raises(E.DuplicateFileError):
        manifest.check_replay(edits, one.unionByName(spark.createDataFrame([(2, 0, 42, "a")], ADD)), none)
    with pytest.raises(E.CorruptManifestError):
        manifest.check_replay(edits.where("false"), one, none)
    assert manifest.level_count(spark.createDataFrame([(1, 2, 1, "a")], ADD)).first()[0] == 3
    for name in ("", "a/b", "  "):
        with pytest.raises(E.PointerNameError):
            manifest.check_pointer_name(name)


def test_names(spark):
    names = spark.createDataFrame([(f"{7:020d}.sst",), ("000007.sst",), ("x.sst",), (f"{9:020d}.tmp",), ("9" * 20 + ".sst",)], "name string")
    live = spark.createDataFrame([(1, 0, 8, "a")], ADD)
    assert [r["file_id"] for r in manifest.orphans(names, live).collect()] == [7]
    assert [r["file_id"] for r in manifest.missing(names, live).collect()] == [8]


def test_rotation_and_packing(spark):
    per = spark.createDataFrame([(0, i, n) for i, n in enumerate([10, 10, 10, 40, 5, 5])], "log_id bigint, batch_id bigint, bytes bigint")
    assert [r["memtable"] for r in runs.rotate(per, 25).orderBy("batch_id").collect()] == [0, 0, 0, 1, 2, 2]
    kv = log(spark, ("key", 10, 1, "v10"), ("key", 8, 1, "v8"), ("key", 5, 1, "v5"), ("key", 2, 1, "v2")).withColumn("sst_id", F.lit(1).cast("bigint"))
    packed = runs.pack(kv, 64)
    assert [(r["seqno"], r["block_idx"]) for r in packed.orderBy("rn").collect()] == [(10, 0), (8, 0), (5, 1), (2, 1)]
    foot = runs.footers(runs.blocks(packed)).first()
    assert (foot["data_blocks"], foot["entry_count"], foot["index_offset"]) == (2, 4, 23 + 22 + 22 + 22 + 8)


def test_compaction(spark):
    kv = log(spark, ("a", 1, 1, "1"), ("a", 4, 2, None), ("b", 2, 1, "2"), ("b", 5, 1, "5"))
    rows = lambda df: sorted((r["user_key"], r["seqno"]) for r in df.collect())
    assert rows(runs.compact(kv)) == [("b", 5)]
    assert rows(runs.compact(kv, oldest_included=False)) == [("a", 4), ("b", 5)]
    assert rows(runs.compact(kv, snapshots=(2,))) == [("a", 1), ("a", 4), ("b", 2), ("b", 5)]


def test_verify(spark):
    none = log(spark).limit(0)
    pending = log(spark, ("alpha", 1, 1, "present"))
    actual = spark.createDataFrame([("alpha", "present")], "user_key string, value string")
    assert verify.verify(actual, none, pending).count() == 0
    assert verify.verify(actual.limit(0), none, pending).count() == 0
    assert verify.verify(actual, pending, log(spark, ("beta", 2, 1, "x"))).count() == 0
    assert [r["user_key"] for r in verify.verify(actual.limit(0), pending, none).collect()] == ["alpha"]


def test_workload(spark):
    rows = verify.workload(spark, verify.WorkloadConfig(operations=500)).collect()
    assert rows == verify.workload(spark, verify.WorkloadConfig(operations=500)).collect()
    known = set()
    for r in sorted(rows, key=lambda r: (r["op_id"], r["op_idx"])):
        assert r["op_type"] == 1 or r["key"] in known
        known.add(r["key"]) if r["op_type"] == 1 else None
    sizes = {}
    for r in rows:
        sizes.setdefault((r["op_id"], r["kind"]), 0)
        sizes[(r["op_id"], r["kind"])] += 1
    assert all(2 <= n <= 4 if kind == "batch" else n == 1 for (_, kind), n in sizes.items())
    with pytest.raises(E.InvalidOptionError):
        verify.WorkloadConfig(put_pct=90)
