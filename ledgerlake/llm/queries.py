"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import ann, langid, licenses, matroska, mixing, packing, simhash, substring_dedup, tokencount, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out)
    found = langid.identify(docs.select("doc_id", "text"), train)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("starts", F.array_join(F.transform("starts", lambda s: F.concat_ws("@", s["label"], s["start"].cast("string"))), ","))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.read_vocabulary())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("h")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_substring_dedup, op3_packing, op4_nearest_neighbours, op5_license_scan,
        op6_warc, op7_token_counts, op8_source_mixing, op9_simhash_near_dedup, op10_matroska,
    )
}

#: Bare base32 of a SHA-1: forty hexadecimal digits as 160 bits, taken five at a time.
_BASE32 = """list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, i + k + 1, 1) AS INTEGER) * (1 << (4 - k)))) AS INTEGER), 1)), 'string_agg', '')"""



def _values(rows: list[tuple], names: str) -> str:
    """Rows of numbers and plain strings as a SQL table."""
    return "(SELECT * FROM (VALUES " + ", ".join(str(r) for r in rows) + f") v({names}))"


_PHRASES = _values([(i, label, len(p.split()), k, w) for i, (p, label) in enumerate(licenses.BASE_PHRASES.items()) for k, w in enumerate(p.split())], "n, label, len, k, word")
_TEMPLATE_WORDS = _values([(t, k, w) for t, x in enumerate(licenses.TEMPLATES) for k, w in enumerate(x.words.split())], "t, p, word")
_MANDATORY = _values([(t, m) for t, x in enumerate(licenses.TEMPLATES) for m in x.mandatory], "t, phrase")
_LABELS = _values([(t, x.label) for t, x in enumerate(licenses.TEMPLATES)], "t, label")

ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{licenses.ASCII_UPPER}', '{licenses.ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        phrases AS {_PHRASES}, template AS {_TEMPLATE_WORDS}, mandatory AS {_MANDATORY}, named AS {_LABELS},
        word AS MATERIALIZED (SELECT * FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d)
            WHERE word IN (SELECT word FROM phrases UNION SELECT word FROM template)),
        base AS (SELECT rid, label, i - k AS start FROM word JOIN phrases USING (word) GROUP BY rid, n, label, len, i - k HAVING count(*) = len),
        based AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid),
        df AS (SELECT word, count(DISTINCT rid) AS df FROM word GROUP BY word),
        rare AS (SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS r
            FROM (SELECT DISTINCT t, word FROM template) LEFT JOIN df USING (word)) WHERE r <= {licenses.RARE_WORDS}),
        posting AS (SELECT t, p, word, count(*) OVER (PARTITION BY t) AS needed FROM template JOIN rare USING (t, word)),
        vote AS (SELECT rid, t, i - p AS start, count(*) / needed AS share FROM word JOIN posting USING (word) GROUP BY rid, t, i - p, needed
            HAVING count(*) / needed >= {licenses.AGREEING}),
        agreed AS (SELECT vote.*, label FROM vote JOIN named USING (t) JOIN d USING (rid)
            WHERE NOT EXISTS (SELECT 1 FROM mandatory m WHERE m.t = vote.t AND NOT contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || m.phrase || ' '))),
        told AS (SELECT rid, max(share) AS share, string_agg(label || '@' || CAST(start AS VARCHAR), ',' ORDER BY t, start) AS starts FROM agreed GROUP BY rid),
        every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM agreed) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0 END, coalesce(share, 0)) AS score,
            coalesce(starts, '') AS starts
        FROM d LEFT JOIN based USING (rid) LEFT JOIN told USING (rid) LEFT JOIN every USING (rid)""",
    "op6_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT *, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
        b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
            1 + 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), 'string_agg', '') AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
}
