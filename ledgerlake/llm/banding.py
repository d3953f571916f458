"""MinHash banding: candidates from bands, exact Jaccard similarity on them, links that span components.

``h`` names a text by a hash of its words; ``bands`` are its band keys. Texts that share a key are
a bucket. Inside a bucket links are exact: its most widely met member is compared with all
others first, and what is still apart after that is compared in blocks, at most BLOCK_MEMBERS
members and BLOCK_WORDS words to a block (one at least), so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import connected_components, discard, maybe_broadcast, staged

SHINGLE, SIMILARITY = 5, 0.8
RECALL = 0.999
#: Members and words of a block of a bucket.
BLOCK_MEMBERS, BLOCK_WORDS = 1024, 500_000
#: Sets that hold an element up to which it is counted by its posting.
WIDE_POSTING = 64

_rng = np.random.default_rng(20_240_229)
_odd = lambda n: _rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE_MUL, _MIN_MUL, _MIN_XOR, _BAND_MUL = _odd(SHINGLE), _odd(256), _odd(256), _odd(256)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_bands: int = 7) -> tuple[int, int]:
    """Bands and rows a band: the most selective rows with which ``max_bands`` or fewer reach the recall."""
    best = (max_bands, 1)
    for rows in range(1, 17):
        for bands in range(1, max_bands + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(hashes: np.ndarray, width: int, factors: np.ndarray) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * factors[0]
    for i in range(1, width):
        out += hashes[i : n + i] * factors[i]
    return mixed(out)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of fewer words, the whole sequence."""
    return np.unique(runs(word_hashes(words), min(SHINGLE, max(1, len(words))), _SHINGLE_MUL))


def signatures(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of word ranges of SHINGLE words or more, a row for each."""
    s = np.append(runs(hashes, SHINGLE, _SHINGLE_MUL), np.uint64(2**64 - 1))
    cuts = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
    keys = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            low = np.minimum.reduceat((s ^ _MIN_XOR[k]) * _MIN_MUL[k], cuts)[::2]
            key = mixed(key * _BAND_MUL[k] + low)
        keys[:, band] = key
    return keys


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int((x[at] == y).sum()) if len(x) else 0
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def linked_inside(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the smallest position of its component under Jaccard links, all pairs compared.

    Common elements are counted by a matrix product, elements that few sets hold by their
    postings, so the work on a group of near copies stays far below a comparison of every pair.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    wide = np.flatnonzero(count > WIDE_POSTING)
    number = np.full(len(count), -1)
    for start in range(0, len(wide), 4096):  # so many columns of the product at a time
        part = wide[start : start + 4096]
        number[part] = np.arange(len(part))
        at = number[column] >= 0
        dense = np.zeros((m, len(part)), np.float32)
        dense[owner[at], number[column[at]]] = 1
        common += dense @ dense.T
        number[part] = -1
    narrow = np.flatnonzero((count[column] > 1) & (count[column] <= WIDE_POSTING))
    narrow = narrow[np.argsort(column[narrow], kind="stable")]
    for posting in np.split(owner[narrow], np.flatnonzero(np.diff(column[narrow])) + 1) if len(narrow) else []:
        common[np.ix_(posting, posting)] += 1
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    label = np.full(m, -1)
    for first in range(m):
        if label[first] >= 0:
            continue
        front = np.array([first])
        label[first] = first
        while len(front):
            reached = near[front].any(axis=0) & (label < 0)
            front = np.flatnonzero(reached)
            label[front] = first
    return label


def verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose texts (``h, body``) have the Jaccard similarity, as a staged table."""
    met = pairs.join(bodies.toDF("b", "y"), "b").join(bodies.toDF("a", "x"), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != last:  # the pairs of a star come one after another
                    last, held = a, shingles(x.as_py().lower().split())
                if alike(held, shingles(y.as_py().lower().split()), similarity):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return staged(met.mapInArrow(run, "a bigint, b bigint"), "links")


def block_links(classed: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join what is apart inside a bucket; ``classed``: ``key, h, words, root``. A staged table.

    Members that their bucket's star does not link (each a root of its own) are compared with each
    other and with those that it links, block by block; pairs among the latter are joined already.
    """
    parts = classed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("t"))
    most = F.max(F.struct("n", "t", "root")).alias("top")
    # Two members were compared by their star.
    apart = parts.groupBy("key").agg(most, F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum("t").alias("t")).where("roots > 1 and n > 2")
    blocks = lambda n, t: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(t / BLOCK_WORDS), F.lit(1)).cast("bigint")
    whole = blocks(F.col("n"), F.col("t")) == 1
    dealt = apart.select(
        "key", F.when(~whole, F.col("top.root")).alias("main"),
        F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("t") - F.col("top.t"))).alias("p"),
        F.when(whole, 0).otherwise(blocks(F.col("top.n"), F.col("top.t"))).alias("r"),
    )
    inner = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    block = F.when(inner, F.col("p") + F.pmod(F.xxhash64("h"), F.col("r"))).otherwise(F.pmod(F.xxhash64("h"), F.col("p")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(inner, F.col("p")).otherwise(F.col("p") + F.col("r")) - 1)
    placed = classed.join(dealt, "key").withColumn("block", block).select("key", "h", "block", F.explode(others).alias("other"))
    tasks = staged(placed.select("key", "h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "blocks")
    grouped = tasks.join(bodies, "h").groupBy("key", "i", "j").agg(F.collect_list(F.struct("h", "body")).alias("xs")).select("xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column(0)[i].values
                h = group.field("h").to_numpy()
                label = linked_inside([shingles(x.as_py().lower().split()) for x in group.field("body")], similarity)
                other = np.flatnonzero(label != np.arange(len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[label[other]]), pa.array(h[other])], ["a", "b"])

    links = staged(grouped.mapInArrow(run, "a bigint, b bigint").distinct(), "links", rows=4)
    discard(tasks)
    return links


def band_classes(uniq: DataFrame, bodies_of: Callable[[DataFrame], DataFrame], similarity: float, more: DataFrame | None = None) -> DataFrame:
    """``node, root`` (of ``h``) of the texts that have a link inside a shared band; ``uniq``: ``h, words, bands``.

    ``bodies_of`` gives ``h, body`` for a table of the ``h`` that share a band with another. ``more``
    (``h, words, key``) adds buckets of other makes, whose texts are compared in the same way.
    """
    keyed = uniq.select("h", "words", F.explode("bands").alias("key"))
    if more is not None:
        keyed = keyed.unionByName(more)
    shared = staged(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "shared-bands")
    members = staged(keyed.join(maybe_broadcast(shared, 8), "key").select("key", "h", "words"), "members")
    # Bands that gather the same texts are one bucket.
    facts = members.groupBy("key").agg(F.min("h").alias("lo"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("all"), F.expr("bit_xor(xxhash64(h))").alias("all2"))
    buckets = staged(facts.groupBy("lo", "n", "all", "all2").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    sized = staged(members.join(maybe_broadcast(buckets), "key").select("key", "h", "words", "n"), "members")
    asked = staged(sized.select("h").distinct(), "asked")
    bodies = staged(bodies_of(asked), "bodies")
    if bodies.count() > asked.count():  # rows that repeat an id and a text
        bodies = staged(bodies.groupBy("h").agg(F.min("body").alias("body")), "bodies")
    discard(shared, members, buckets, asked)
    # The member that meets most others is the likeliest to be what the rest was copied from.
    weights = sized.groupBy("h").agg(F.sum("n").alias("met"))
    centres = staged(sized.join(weights, "h").groupBy("key").agg(F.max(F.struct("met", "h")).alias("c")).select("key", F.col("c.h").alias("a")), "centres")
    pairs = staged(sized.join(maybe_broadcast(centres), "key").where("h <> a").select("a", F.col("h").alias("b")).distinct(), "pairs")
    stars = verified(pairs, bodies, similarity)
    discard(pairs)
    met = stars.select("a", F.col("b").alias("h"), F.lit(True).alias("linked"))
    rooted = sized.join(maybe_broadcast(centres), "key").join(maybe_broadcast(met), ["a", "h"], "left")
    classed = staged(rooted.select("key", "h", "words", F.when(F.col("linked"), F.col("a")).otherwise(F.col("h")).alias("root")), "classed")
    more = block_links(classed, bodies, similarity)
    out = staged(connected_components(stars.unionByName(more)), "comps")
    discard(centres, sized, bodies, stars, classed, more)
    return out
