"""Substring deduplication: paragraphs by MinHash banding, and passages inside paragraphs.

Paragraphs are lines. Their five-word shingles are MinHashed into bands tuned for recall, the
paragraphs that collide are verified by exact Jaccard, and components of verified links are
repeats everywhere but in the document that has them first. A passage that was pasted into the
middle of a line is no paragraph, and one that goes over several lines is none; for these,
anchors are winnowed from each text so that every window of ``min_words`` words holds one, and
around the anchors that several documents share the windows at every position are compared
exactly: all words of a shared passage go, ends included.

Paragraphs of any length are compared. Only repeats of ``min_words`` words or more are removed;
shorter ones, such as a common closing line, are reported and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.banding import SHINGLE, SIMILARITY, band_classes, runs, signatures, tune_bands, word_hashes
from ledgerlake.llm.common import BROADCAST_BYTES, discard, fresh, maybe_broadcast, staged

#: Words of a repeat that is removed: a little under fifty, so that ends that were edited or run together do not save a passage of over fifty.
MIN_WORDS = 45
DOC, LINE = 0, 1

_rng = np.random.default_rng(20_240_301)
_ANCHOR_MUL, _WINDOW_MUL = (_rng.integers(0, 2**63, 1024, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def anchor_width(min_words: int) -> int:
    return max(1, min_words // 4)


def anchors(hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of winnowed short runs of words: each window of ``min_words`` words holds its smallest."""
    width = anchor_width(min_words)
    span = min_words - width + 1
    g = runs(hashes, width, _ANCHOR_MUL)
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    at = at[np.diff(at, prepend=-1) > 0]
    # Of equal ones side by side, as in a repeated word, the ends and one a span are enough.
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (np.diff(at) == 1) & (g[at[1:]] == g[at[:-1]])
    first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(at))))
    at = at[~same[:-1] | ~same[1:] | ((np.arange(len(at)) - first) % span == 0)]
    return at, g[at]


def paragraphs(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased words of a text and the word number at which each line starts, with the end."""
    words: list[bytes] = []
    starts = [0]
    for line in text.lower().split(b"\n"):
        words += line.split()
        starts.append(len(words))
    return words, np.array(starts, np.int64)


def of_words(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def scan(docs: DataFrame, id_col: str, text_col: str, min_words: int, bands: int, rows: int) -> DataFrame:
    """One pass over the texts: a row for each document, with its anchors, and one for each paragraph, with its bands.

    ``at``: places of a document's anchors, ``keys``: their hashes, or the bands of a paragraph of
    SHINGLE words or more (shorter ones are alike only if they are equal).
    """
    schema = "kind tinyint, doc_id bigint, start int, words int, h bigint, at array<int>, keys array<bigint>"
    names = ["kind", "doc_id", "start", "words", "h", "at", "keys"]

    def listed(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            kinds, ids, at, sizes, hs, places, keys = [], [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words, starts = paragraphs(text or b"")
                hashes = word_hashes(words)
                begin, end = starts[:-1], starts[1:]
                begin, end = begin[end > begin], end[end > begin]
                n = len(begin)
                place, marks = anchors(hashes, min_words)
                long = end - begin >= SHINGLE
                banded = signatures(hashes, begin[long], end[long], bands, rows).view(np.int64) if long.any() else np.zeros((0, bands), np.int64)
                kinds += [DOC] + [LINE] * n
                ids += [doc_id] * (1 + n)
                at += [0, *begin]
                sizes += [len(words), *(end - begin)]
                hs += [of_words(words), *(of_words(words[a:b]) for a, b in zip(begin, end))]
                places += [place] + [none] * n
                keys.append(marks.view(np.int64))
                of_line = iter(banded)
                keys += [next(of_line) if x else none for x in long]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int8()), pa.array(ids, pa.int64()), pa.array(np.array(at, np.int32)), pa.array(np.array(sizes, np.int32)), pa.array(np.array(hs, np.uint64).view(np.int64)), listed(places, pa.int32()), listed(keys, pa.int64())],
                names,
            )

    return staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "scan")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` of the documents that ``ids`` (a staged table) names, and no others if it is short."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if 8 * ids.count() <= BROADCAST_BYTES else texts


def entries(lists: DataFrame, column: str) -> int:
    """Elements of all arrays of a column together."""
    return lists.agg(F.sum(F.size(column))).first()[0] or 0


def line_bodies(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h, body`` of the paragraphs ``wanted`` (``doc_id, hs``, staged): their words, single-spaced."""
    lists = maybe_broadcast(wanted, rows=entries(wanted, "hs"))  # at least one a document
    asked = texts_of(docs, wanted.select("doc_id"), id_col, text_col).join(lists, "doc_id").select("text", "hs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bodies = [], []
            for text, hs in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                hs = set(hs)
                for line in (text or b"").lower().split(b"\n"):
                    words = line.split()
                    if len(words) < SHINGLE:
                        continue
                    h = int(np.uint64(of_words(words)).view(np.int64))
                    if h in hs:
                        hs.discard(h)
                        found.append(h)
                        bodies.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(bodies, pa.binary())], ["h", "body"])

    return asked.mapInArrow(run, "h bigint, body binary")


def paragraph_classes(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``h, keeper`` for the paragraphs whose class occurs in several documents; keeper: the smallest of these. A staged table."""
    uniq = staged(lines.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("words").alias("words"), F.first("keys").alias("bands")), "uniq")

    def bodies_of(asked: DataFrame) -> DataFrame:
        wanted = staged(uniq.select("h", "least").join(maybe_broadcast(asked, 8), "h").groupBy(F.col("least").alias("doc_id")).agg(F.collect_list("h").alias("hs")), "wanted")
        return line_bodies(docs, wanted, id_col, text_col)

    comps = band_classes(uniq.select("h", "words", "bands"), bodies_of, similarity)
    roots = maybe_broadcast(comps.withColumnRenamed("node", "h"))
    alone = uniq.where("least < most").join(roots, "h", "left_anti").select("h", F.col("least").alias("keeper"))
    linked = uniq.select("h", "least", "most").join(roots, "h")
    classes = linked.groupBy("root").agg(F.min("least").alias("keeper"), F.max("most").alias("last")).where("keeper < last").select("root", "keeper")
    out = staged(alone.unionByName(linked.join(classes, "root").select("h", "keeper")), "classes")
    discard(uniq, comps)
    return out


def free_anchors(found: DataFrame, copies: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """``h, doc_id, start`` of the anchors that can tell something new. A staged table.

    Left out are those of whole ``copies`` (``doc_id, h``), which the first holder has also, and
    those inside a removed paragraph (``doc_id, start, words``): what goes cannot keep anything.
    """
    marked = found.where(f"kind = {DOC} and size(at) > 0").select("doc_id", "h", "at", "keys").join(maybe_broadcast(copies), ["doc_id", "h"], "left_anti")
    gone = staged(lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("gone")), "gone")
    gone = maybe_broadcast(gone, rows=entries(gone, "gone"))
    width = anchor_width(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                at, marks = batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                if batch.column(3)[i].is_valid:
                    spans = batch.column(3)[i].values
                    starts, ends = spans.field("start").to_numpy(), spans.field("start").to_numpy() + spans.field("words").to_numpy()
                    k = np.searchsorted(starts, at, side="right") - 1
                    free = (k < 0) | (at + width > ends[k])
                    at, marks = at[free], marks[free]
                out.append((marks, np.full(len(at), doc_id), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "doc_id", "start"])

    return staged(marked.join(gone, "doc_id", "left").select("doc_id", "at", "keys", "gone").mapInArrow(run, "h bigint, doc_id bigint, start int"), "anchors")


def shared_windows(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``doc_id, start, h`` of all windows that hold an anchor which several documents share, at every position. A staged table.

    ``marks``: ``h, doc_id, start`` of the anchors. A window that two documents share holds an
    anchor of the same hash in both, so none is left out.
    """
    # Tables of their own, here and below, so that the joins with them are such as Spark splits where many rows share a hash.
    met = staged(marks.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "met")
    asked = staged(marks.join(maybe_broadcast(met, 8), "h").groupBy("doc_id").agg(F.collect_set("start").alias("at")), "shared-anchors")
    lists = maybe_broadcast(asked, rows=asked.count() + entries(asked, "at") // 4)  # of four bytes each
    texts = texts_of(docs, asked.select("doc_id"), id_col, text_col).join(lists, "doc_id").select("doc_id", "text", "at")
    before = min_words - anchor_width(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                h = runs(word_hashes((text or b"").lower().split()), min_words, _WINDOW_MUL)
                inside = np.zeros(len(h) + 1, np.int64)
                np.add.at(inside, np.clip(at - before, 0, len(h)), 1)
                np.add.at(inside, np.clip(at + 1, 0, len(h)), -1)
                here = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                ids.append(np.full(len(here), doc_id))
                starts.append(here.astype(np.int32))
                hs.append(h[here])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(hs).view(np.int64))], ["doc_id", "start", "h"])

    out = staged(texts.mapInArrow(run, "doc_id bigint, start int, h bigint"), "windows")
    discard(met, asked)
    return out


def merge_spans(grouped: DataFrame) -> DataFrame:
    """``doc_id, removed, n_removed, kept_in, short`` of grouped spans; overlapping word ranges become one."""

    def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
        cuts = np.flatnonzero(starts[1:] > ends[:-1])
        return np.stack([starts[np.append(0, cuts + 1)], ends[np.append(cuts, len(ends) - 1)]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, counts, short = [], [], []
            for i in range(batch.num_rows):
                starts, words, long = (batch.column(1)[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "words", "long"))
                out = merged(starts[long], (starts + words)[long])
                spans.append(out.tolist())
                counts.append(int((out[:, 1] - out[:, 0]).sum()))
                rest = np.unique(np.stack([starts[~long], (starts + words)[~long]], axis=1), axis=0)
                # Those inside a removed range go with it.
                k = np.searchsorted(out[:, 0], rest[:, 0], side="right") - 1
                short.append(rest[(k < 0) | (rest[:, 1] > out[k, 1]) if len(out) else np.ones(len(rest), bool)].tolist())
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(counts, pa.int64()), batch.column(2), pa.array(short, kind)], ["doc_id", "removed", "n_removed", "kept_in", "short"])

    return grouped.mapInArrow(run, "doc_id bigint, removed array<array<bigint>>, n_removed bigint, kept_in array<bigint>, short array<array<bigint>>")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, removed, kept_in, short``.

    ``removed``: merged [start, end) word ranges, of ``min_words`` words or more each, that repeat
    what another document has first; ``kept_in``: the documents that keep a copy. A repeat is a
    paragraph (line) in a class that several documents share, or a window of ``min_words`` words,
    wherever it starts, that several share. ``short``: the ranges of shorter paragraphs that
    repeat what another document has first; these stay. The smallest id keeps; repeats inside one
    document are left alone. Null and empty texts have no words. Rows with a null id come out with
    nothing removed and are compared with nothing, for no document could be named that keeps
    or loses. Rows that repeat an id are one document for keeping and come out as often as they
    go in. Other columns are ignored. A table without rows gives none.
    """
    if not 1 <= min_words <= len(_WINDOW_MUL):
        raise ValueError("min_words is out of range")
    bands, rows = tune_bands(similarity)
    found = scan(docs, id_col, text_col, min_words, bands, rows)
    named = found.where("doc_id is not null")
    lines = named.where(f"kind = {LINE}")
    classes = paragraph_classes(docs, lines, id_col, text_col, similarity)
    repeated = staged(lines.join(maybe_broadcast(classes), "h").where("doc_id <> keeper").select("doc_id", "start", "words", "keeper"), "repeated")
    wholes = named.where(f"kind = {DOC} and words >= {min_words}").select("doc_id", "h", "words")
    firsts = wholes.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("h", "keeper")
    copies = staged(wholes.join(maybe_broadcast(staged(firsts, "firsts")), "h").where("doc_id <> keeper"), "copies")
    marks = free_anchors(named, copies.select("doc_id", "h"), repeated.where(f"words >= {min_words}"), min_words)
    windows = shared_windows(docs, marks, id_col, text_col, min_words)
    firsts = staged(windows.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("h", "keeper"), "firsts")
    lost = windows.join(maybe_broadcast(firsts), "h").where("doc_id <> keeper").select("doc_id", "start", F.lit(min_words).alias("words"), "keeper")
    spans = repeated.unionByName(copies.select("doc_id", F.lit(0).alias("start"), "words", "keeper")).unionByName(lost)
    long = F.col("words") >= min_words
    grouped = spans.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "words", long.alias("long"))).alias("spans"), F.array_sort(F.collect_set(F.when(long, F.col("keeper")))).alias("kept_in")
    )
    removed = staged(merge_spans(grouped), "removed")
    out = found.where(f"kind = {DOC}").select("doc_id", F.col("words").cast("bigint").alias("n_words")).join(removed, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<array<bigint>>")).alias("removed"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
        F.coalesce("short", F.array().cast("array<array<bigint>>")).alias("short"),
    )
    result = staged(out, "repeats")
    discard(found, classes, repeated, copies, marks, windows, firsts, removed)
    return result


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without their repeats, with the columns they came with, whatever their names and types.

    A document that loses all of its words goes; others keep what is left. ``length_col``, if there is such a column, becomes the new text's length.
    Rows with a null id stay as they are. Rows that repeat an id with different texts lose what the
    first of them loses, by its places.
    """
    found = find_repeats(docs, id_col, text_col, similarity, min_words)
    key, gone, spans = (fresh(x, docs) for x in ("key_", "gone_", "spans_"))
    least = F.min_by(F.struct("n_words", "n_removed", "removed"), F.struct("n_words", "n_removed")).alias("x")
    changed = found.where("n_removed > 0").groupBy(F.col("doc_id").alias(key)).agg(least).select(key, (F.col("x.n_removed") >= F.col("x.n_words")).alias(gone), F.col("x.removed").alias(spans))
    changed = staged(changed, "changed")
    discard(found)
    changed = maybe_broadcast(changed, rows=changed.count() + entries(changed, spans))
    joined = docs.join(changed, F.col(id_col).cast("bigint") == F.col(key), "left").where(F.col(gone).isNull() | ~F.col(gone))
    text, ranges = F.col(text_col), F.col(spans)
    pieces = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    begin = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.get(ranges, i - 1), F.lit(1)))
    end = lambda i: F.when(i == F.size(ranges), F.size(pieces).cast("bigint")).otherwise(F.get(F.get(ranges, i), F.lit(0)))
    rest = F.transform(F.sequence(F.lit(0), F.size(ranges)), lambda i: F.array_join(F.slice(pieces, (begin(i) + 1).cast("int"), F.greatest(end(i) - begin(i), F.lit(0)).cast("int")), ""))
    cut_text = F.concat(F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0), F.array_join(rest, ""))
    out = joined.withColumn(text_col, F.when(ranges.isNull(), text).otherwise(cut_text))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull() | ranges.isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
