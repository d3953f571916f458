"""Approximate nearest neighbours by largest inner product: inverted file and product quantisation.

Coarse centroids cut the vectors into lists; what a vector differs from its centroid is
product-quantised. A query probes the lists of largest centroid product; per block of a list
its asymmetric distance tables rank the codes, and the best are ranked again by the exact
inner product of the original vectors in double precision. Every row is indexed; only the
centroids and code books are fitted on a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, staged

#: Vectors on which centroids and code books are fitted.
FIT_VECTORS = 20_000
MIN_LISTS, MAX_LISTS = 64, 4096
#: Rows of a list and queries of a list that one task compares at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 256
SUBSPACE, CODES = 4, 64


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dims
    books: np.ndarray  # subspaces x CODES x SUBSPACE
    scales: np.ndarray  # root mean square residual of each list: dense lists are coded as finely as wide ones


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def parts(x: np.ndarray) -> np.ndarray:
    """Vectors as subspaces x rows x SUBSPACE, filled up with zeros."""
    gap = -x.shape[1] % SUBSPACE
    x = np.pad(x, ((0, 0), (0, gap)))
    return x.reshape(len(x), -1, SUBSPACE).transpose(1, 0, 2)


def fit(sample: np.ndarray, lists: int) -> Index:
    centroids = k_means(sample, lists)
    at = nearest(sample, centroids)
    rest = sample - centroids[at]
    square = np.bincount(at, (rest * rest).sum(axis=1), len(centroids)) / np.maximum(1, np.bincount(at, minlength=len(centroids)))
    scales = np.where(square > 1e-24, np.sqrt(square), 1.0)
    rest = parts(rest / scales[at, None])
    books = [k_means(p, CODES, rounds=5) for p in rest]
    books = [np.vstack([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books]
    return Index(centroids, np.stack(books), scales)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = nearest(x, index.centroids)
    rest = parts((x - index.centroids[at]) / index.scales[at, None])
    return at, np.stack([nearest(p, b) for p, b in zip(rest, index.books)], axis=1).astype(np.uint8)


def compare(index: Index, number: int, qs: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int, reranked: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places of its best rows and their exact scores in one block of a list, ``ids`` ascending."""
    tables = np.einsum("sqd,scd->sqc", parts(qs), index.books) * index.scales[number]
    near = qs @ index.centroids[number]
    for row in range(len(qs)):
        rough = near[row] + tables[np.arange(codes.shape[1]), row][np.arange(codes.shape[1])[:, None], codes.T].sum(axis=0)
        values = np.unique(rough)  # codes that tie count once: copies do not crowd out others
        best = np.flatnonzero(rough >= values[-min(reranked, len(values))])
        exact = (vectors[best] * qs[row]).sum(axis=1)  # each row summed alike, so equal vectors tie exactly
        order = np.lexsort((ids[best], -exact))[:k]
        yield row, best[order], exact[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, e, row``: rows that take part; ``row`` tells rows apart that repeat an id, even with its vector."""
    finite = F.forall(F.col("e"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(finite & F.exists("e", lambda x: x != 0))
    alike = rows.groupBy("vec_id", "e").agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return alike.select("vec_id", "e", F.xxhash64("vec_id", "e", "copy").alias("row"))


RESULT = "query_id bigint, rank int, vec_id bigint, score double, query_row bigint"


def search(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, probes: float = 0.85, reranked: int = 256, fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score, query_row``: the k nearest found of every query row, nearest first.

    ``is_query``: a condition on ``vec_id``. Candidates are all rows but the query's own; rows that
    repeat an id, or an id and its vector, are rows of their own, and queries of their own, told apart by
    ``query_row``. Vectors that are null, empty, zero, or hold a null or non-finite component take
    no part, nor do rows without an id. Vectors are compared with those of the same dimension.
    Ties go to the smaller id. ``probes``: the share of lists that a query visits; it goes on to
    further ones until they hold k candidates, or to all. ``reranked``: codes of a list's block that
    are compared exactly. An empty table gives no rows.
    """
    rows = staged(usable(vectors, id_col, vec_col), "vectors")
    dims = sorted(r["d"] for r in rows.select(F.size("e").alias("d")).distinct().collect())  # few: an index each
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for i, d in enumerate(dims):
        found = search_alike(rows.where(F.size("e") == d) if len(dims) > 1 else rows, is_query, k, probes, reranked, fit_vectors)
        out = out.unionByName(found) if i else found
    return out


def search_alike(rows: DataFrame, is_query: F.Column, k: int, probes: float, reranked: int, fit_vectors: int) -> DataFrame:
    """The search over ``vec_id, e, row`` of one dimension."""
    spark = rows.sparkSession
    total = rows.count()
    # a bounded sample by hash, fetched once; everything else stays distributed
    space = 1 << 30
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(space)) < min(space, -(-space * fit_vectors // total))).limit(2 * fit_vectors).toArrow()
    if not sample.num_rows:
        sample = rows.limit(fit_vectors).toArrow()
    order = np.argsort(sample.column("row").to_numpy(), kind="stable")
    points = np.stack(sample.column("e").to_numpy(zero_copy_only=False))[order]
    lists = min(MAX_LISTS, max(MIN_LISTS, round(math.sqrt(total) / 4)))
    index = fit(points, lists)
    lists = len(index.centroids)
    visits = max(1, math.ceil(probes * lists))
    sent = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, codes = encode(sent.value, np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "e", "row", "list", "code"])

    indexed = staged(rows.mapInArrow(assign, "vec_id bigint, e array<double>, row bigint, list int, code binary"), "ivf", rows=2048)
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # one row a list
    cuts = F.array(*[F.lit(-(-sizes.get(i, 0) // BLOCK_ROWS) or 1) for i in range(lists)])
    blocks = (
        indexed.withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(cuts, F.col("list") + 1).cast("bigint")))
        .groupBy("list", "block")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "code", "e"))).alias("rows"))
    )
    held = np.array([sizes.get(i, 0) for i in range(lists)], np.int64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            near = np.argsort(-(x @ sent.value.centroids.T), axis=1, kind="stable")
            # its own row and k others, if there are so many
            needed = (np.cumsum(held[near], axis=1) < k + 1).sum(axis=1) + 1
            take = np.arange(lists) < np.maximum(visits, needed)[:, None]
            who = pa.array(np.nonzero(take)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), batch.column(2).take(who), pa.array(near[take].astype(np.int32))], ["query_id", "q", "query_row", "list"])

    asked = rows.where(is_query).mapInArrow(probe, "query_id bigint, q array<double>, query_row bigint, list int")
    groups = max(1, math.ceil(rows.where(is_query).count() / BLOCK_QUERIES))
    asked = asked.groupBy("list", F.pmod(F.xxhash64("query_row"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("query_id", "query_row", "q")).alias("queries"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                found, wanted = batch.column(1)[i].values, batch.column(2)[i].values
                ids, keys = found.field("vec_id").to_numpy(), found.field("row").to_numpy()
                vectors = np.stack(found.field("e").to_numpy(zero_copy_only=False))
                codes = np.frombuffer(b"".join(found.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                qs, qids, qrows = np.stack(wanted.field("q").to_numpy(zero_copy_only=False)), wanted.field("query_id").to_numpy(), wanted.field("query_row").to_numpy()
                out = [(np.full(len(at), qids[one]), np.full(len(at), qrows[one]), ids[at], keys[at], scores) for one, at, scores in compare(sent.value, number, qs, ids, codes, vectors, k + 1, reranked)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "query_row", "vec_id", "row", "score"])

    near = staged(blocks.join(asked, "list").select("list", "rows", "queries").mapInArrow(rank, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score double"), "near", rows=16)
    discard(indexed)
    sent.unpersist()
    order_ = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = near.where("query_row <> row").withColumn("rank", F.row_number().over(order_))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
