"""The registered queries and the pipeline on the smallest tables and on empty ones."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerlake.llm import licenses, queries, simhash, substring_dedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
KEYS = {"op4_nearest_neighbours": "embeddings", "op6_warc": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    rows = got.count()
    whole = spark.read.parquet(f"{DATA}/{KEYS.get(name, 'documents')}.parquet").count()
    if name == "op4_nearest_neighbours":
        assert rows == 20 * -(-whole // 20)
    elif name == "op8_source_mixing":
        assert got.select("doc_id").distinct().count() == whole
    else:
        assert rows == whole


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{DATA}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_license_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    texts = [f"some words before, {t.words.upper()}; and after {t.words}" for t in licenses.TEMPLATES]
    texts += [None, "", "...", "mit license mit license", "GNU GENERAL PUBLIC LICENSE", "Kmit license", "\u212amit license", "CC-BY mit_license\x00x", "mit license" + " q" * 50_000]
    texts += ["licensed under apache license version 2 0 the the", "redistribution in source of binary forms and use", texts[0], texts[3]]
    rows = [(None if i % 7 == 3 else i // 2, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op5_license_scan"])
    got = queries.op5_license_scan(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == corpus_pipeline.COLUMNS and out.schema.simpleString() == docs.select(*corpus_pipeline.COLUMNS).schema.simpleString(), name
        from ledgerlake.llm.common import staged

        before, docs = docs, staged(out, "stage")
        if name == "simhash_near_dedup":
            comps = simhash.near_copies(before).groupBy("component_id").count().count()
            assert docs.count() == comps
        if name == "substring_dedup":
            assert substring_dedup.find_repeats(docs).where("n_removed > 0").count() <= 2
        if name == "source_mixing":
            assert docs.select("doc_id").distinct().count() == before.count()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert got.count() == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() == got.count()


def test_stages_take_odd_rows(spark):
    """Nulls, repeated rows, very long and empty texts, other columns: what each stage keeps of them."""
    long = "the of " * 50_000
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, long, "en", None, 5), (3, "!!!", None, "s", 3), (1, None, None, None, None), (4, words, "en", "s", 19), (5, words.upper(), "en", "t", 19), (None, words, "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = docs.withColumns({"id_": F.lit(1), "key_": F.lit(2), "h": F.lit(3), "score": F.lit(4), "m": F.create_map(F.lit("a"), F.lit(1))})
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert ids(stages["language_id"](spark, extra, DATA)) == [2, 4, 5, None]  # no letters, no document
    assert ids(stages["simhash_near_dedup"](spark, extra, DATA)) == [1, 2, 3, 4, None, None]  # rows without an id stay
    kept = stages["substring_dedup"](spark, extra, DATA)
    assert ids(kept) == [1, 1, 2, 3, 4, None, None] and {len(r["text"]) for r in kept.where("doc_id = 2").collect()} == {len(long)}
    assert set(ids(stages["source_mixing"](spark, extra, DATA))) == {1, 2, 3, 4, 5, None}
    packed = stages["packing"](spark, extra, DATA).collect()
    assert sorted((r["n_tokens"] for r in packed)) == [0, 0, 0, 1, 60, 60, 60, 100_000]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0, name
