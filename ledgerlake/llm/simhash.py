"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint maps to the vector of bit counts of its sixteen 4-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so links
lie among pairs at Manhattan distance two or less. Those meet at a lattice point at distance
one or less from both: each distinct fingerprint enters the 33 grid cells around its own
vector, and a pair is examined in exactly one of the cells that it shares. Cells with many
members are not paired; there, single-bit neighbours stand in for pairs (two fingerprints
differ in two bits or fewer exactly when some value is within one bit of both), at most 65
fingerprints to a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.banding import SHINGLE, SIMILARITY, band_classes, signatures, tune_bands, word_hashes
from ledgerlake.llm.common import connected_components, discard, fresh, maybe_broadcast, staged
from ledgerlake.llm.substring_dedup import texts_of

#: Members of a cell up to which its pairs are examined; fuller cells take the other exact way.
PAIRED_CELL = 64
#: Shingles whose bits are counted at a time.
SHINGLE_BLOCK = 65_536
#: Bands of whole texts: with so many, four rows a band reach the recall.
MAX_BANDS = 14


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text (ASCII lower-cased, split at white space)."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), 42)
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((digest(b" ".join(run), 42) for run in runs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SHINGLE_BLOCK):
        block = hashes[start : start + SHINGLE_BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp: the fingerprint as a signed bigint) for every row; null text: fp 0. A staged table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint"), "fingerprints")


def _counts(fp: F.Column) -> F.Column:
    """Bit counts of the sixteen 4-bit segments, one in each nibble, one added to each."""
    half = F.shiftrightunsigned(fp, 1)
    mask5, mask3 = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    two = fp.bitwiseXOR(half).bitwiseAND(mask5).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(mask5), 1))
    four = two.bitwiseAND(mask3) + F.shiftrightunsigned(two, 2).bitwiseAND(mask3)
    return four + F.lit(0x1111111111111111)


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges ``a, b`` that join every two distinct fingerprints ``fp`` at ``max_bits`` or fewer.

    Pairs of sparse cells come as they are; in dense cells some are replaced by a path of
    links that hold, so components are exact either way. ``max_bits`` is 0, 1 or 2.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    around = [0] + [sign << (4 * i) if sign > 0 else -(1 << (4 * i)) for i in range(16) for sign in (1, -1)]
    vectors = distinct.select("fp", _counts(F.col("fp")).alias("v"))
    cells = vectors.select("fp", "v", F.explode(F.array(*[F.col("v") + F.lit(d) for d in around])).alias("cell"))
    # Spark takes the counts, up to 33 a fingerprint, for no larger than the fingerprints: never leave it to broadcast them.
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(cells.join(sizes.hint("merge"), "cell"), "cells")
    pairs = (
        shared.where(F.col("members") <= PAIRED_CELL)
        .groupBy("cell")
        .agg(F.collect_list(F.struct("fp", "v")).alias("xs"))
        .select(
            F.explode(
                F.expr(
                    f"""flatten(transform(xs, x -> transform(
                        filter(xs, y -> y.fp > x.fp and bit_count(x.fp ^ y.fp) <= {max_bits}
                               and ((x.v = y.v and cell = x.v) or (x.v <> y.v and cell <= (x.v - cell) + y.v))),
                        y -> struct(x.fp as a, y.fp as b))))"""
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
    )
    dense = shared.where(F.col("members") > PAIRED_CELL).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    met = (
        dense.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("mid"))
        .groupBy("mid")
        .agg(F.collect_list("fp").alias("fps"))  # at most 65 distinct values lie within one bit of another
        .where(F.size("fps") > 1)
    )
    if max_bits == 2:
        stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    else:
        stars = met.select(F.col("mid").alias("a"), F.explode("fps").alias("b")).where(
            f"array_contains(fps, mid) and a <> b and bit_count(a ^ b) <= {max_bits}"
        )
    return pairs.unionByName(stars.distinct())


def components(base: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint of ``base`` (``doc_id, fp``): the smallest id that links reach. A staged table."""
    distinct = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(links(distinct.select("fp"), max_bits))
    linked = comps.join(distinct.withColumnRenamed("fp", "node"), "node")
    roots = linked.groupBy("root").agg(F.min("least").alias("least"))
    moved = comps.join(roots, "root").select(F.col("node").alias("fp"), F.col("least").alias("component_id"))
    # A table of its own, so that joins with it are ones that Spark splits where many rows share a fingerprint.
    return staged(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    component_id is the smallest id that can be reached over links, the row's own included.
    Null and empty texts and texts of white space have fingerprint zero and are linked like
    any other. Rows with a null id take part in linking; they never name a component, and
    one that reaches no id has a null component_id. Repeated rows come out as often as they
    go in. Other columns are ignored.
    """
    base = fingerprints(docs, id_col, text_col, shingle)
    named = components(base, max_bits)
    return base.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketches(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``doc_id, h`` (a hash of all words in order), ``fp`` (the fingerprint), ``words`` (their number) and ``bands`` (of the five-word shingles) for every row with an id. A staged table."""
    bands, rows = tune_bands(similarity, max_bands=MAX_BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, fps, sizes, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                hs.append(xxhash.xxh64_intdigest(b" ".join(words)))
                fps.append(fingerprint(text))
                sizes.append(len(words))
                # Texts too short for a shingle are alike only if they are equal.
                whole = signatures(word_hashes(words), np.array([0]), np.array([len(words)]), bands, rows) if len(words) >= SHINGLE else np.zeros((0, bands), np.uint64)
                keys.append(whole.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hs, fps)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "fp", "words", "bands"])

    rows_ = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows_.mapInArrow(run, "doc_id bigint, h bigint, fp bigint, words bigint, bands array<bigint>"), "sketches")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: classes of texts with a Jaccard similarity of five-word shingles.

    Candidates are the components of SimHash fingerprints, as in ``near_duplicates``, and, as copies may
    differ in more than two bits, texts that share a MinHash band, whatever was replaced, trimmed or
    added. Both are buckets, and inside each bucket links are exact. Texts of the same words in the same order are one node; null
    and empty texts are such. Other columns are ignored.
    """
    base = sketches(docs, id_col, text_col, similarity)
    nodes = staged(base.groupBy("h").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("words").alias("words"), F.first("bands").alias("bands")), "nodes")
    named = components(nodes.select(F.col("least").alias("doc_id"), "fp"))
    similar = nodes.select("h", "words", "fp").join(named.hint("merge"), "fp").select("h", "words", F.xxhash64("component_id").alias("key"))

    def right_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # an id that repeats may have other texts too
            hs = batch.column(0).to_pylist()
            right = [xxhash.xxh64_intdigest(b" ".join(body.as_py().lower().split())) == h % 2**64 for h, body in zip(hs, batch.column(1))]
            yield batch.filter(pa.array(right, pa.bool_()))

    def bodies_of(asked: DataFrame) -> DataFrame:
        wanted = staged(asked.join(nodes.select("h", F.col("least").alias("doc_id")), "h").select("doc_id", "h"), "wanted")
        texts = texts_of(docs, wanted, id_col, text_col).join(wanted, "doc_id")
        return texts.select("h", F.col("text").cast("binary").alias("body")).where("body is not null").mapInArrow(right_texts, "h bigint, body binary")

    comps = band_classes(nodes.select("h", "words", "bands"), bodies_of, similarity, similar)
    rooted = nodes.select("h", "least").join(comps.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = staged(base.select("doc_id", "h").join(rooted.join(least, "root").select("h", "component_id"), "h").select("doc_id", "component_id"), "classes")
    discard(base, nodes, named, comps)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest id, with the columns it came with, whatever their names and types.

    Classes are those of ``near_copies`` at ``similarity``, or without one those of
    ``near_duplicates``. Rows that repeat an id are one document: of these the one whose
    columns (maps aside) have the smallest hash stays. Rows without an id cannot be told apart from the document that they
    repeat and stay.
    """
    found = near_duplicates(docs, id_col, text_col).drop("fingerprint") if similarity is None else near_copies(docs, id_col, text_col, similarity)
    found = staged(found.where("doc_id is not null"), "components")
    name = fresh("id_", docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    again = found.groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name)
    out = staged(gone.unionByName(again).distinct(), "gone")
    twice = staged(again.join(gone, name, "left_anti"), "again")
    discard(found)
    key = F.col(id_col).cast("bigint") == F.col(name)
    once = docs.join(maybe_broadcast(out), key, "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return once
    repeated = docs.join(maybe_broadcast(twice), key, "left_semi")
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])).alias("row_")
    return once.unionByName(repeated.groupBy(F.col(id_col).cast("bigint").alias(name)).agg(row).select("row_.*"))
