"""Language identification with string kernels.

A text is the set of its character n-grams of one to three symbols (blended spectrum,
presence only) over a 64-symbol alphabet of bytes. The kernel of two texts is the cosine of
their presence vectors, over all n-grams: those that no landmark holds add nothing to a
product with one and count in a text's length. Landmark texts give Nystroem features, kernel
ridge regression on these is fitted one language against the rest, and batches of texts are
scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BATCH_ROWS, batches_of, small_batches

#: Bounds of the fit: labelled texts in all and landmarks in all, but about so many texts and one landmark of each language.
TRAIN_TEXTS, LANDMARKS, RIDGE = 600, 96, 1e-3
LEAST_TEXTS = 16
UNKNOWN = "und"
SPACE = 1 + 64 + 64 * 64
TABLE = SPACE + 64**3
SCORED = 64

_symbols = np.zeros(256, np.int32)
_symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
_symbols[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_symbols[128:] = 27 + np.arange(128) % 37


class Model(NamedTuple):
    langs: list[str]
    grams: np.ndarray  # numbers of the n-grams that some landmark holds
    landmarks: np.ndarray  # n-grams x landmarks, presence scaled to unit length
    weights: np.ndarray  # landmarks x languages: Nystroem map and ridge weights in one


def present(text: bytes) -> np.ndarray:
    """Numbers of the n-grams of a text, in no order and with repeats."""
    s = _symbols[np.frombuffer(text, np.uint8)]
    if len(s) > 1:
        s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]  # a run of other characters is one
    out = [1 + s]
    if len(s) > 1:
        two = s[:-1] * 64 + s[1:]
        out.append(65 + two)
        if len(s) > 2:
            out.append(SPACE + two[:-1] * 64 + s[2:])
    return np.concatenate(out)


def presence(texts: list[bytes]) -> Iterator[np.ndarray]:
    flags = np.zeros(TABLE, bool)
    for text in texts:
        at = present(text)
        flags[at] = True
        yield flags
        flags[at] = False


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=TABLE)


def fit(langs: list[str], bits: list[bytes]) -> Model:
    """Model of labelled presence vectors, each packed into bytes."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    per = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:per] for k in range(len(names))])
    grams = np.flatnonzero(np.bitwise_or.reduce([unpacked(bits[i]) for i in chosen]))
    x = np.empty((len(bits), len(grams)), np.float32)
    for row, packed in zip(x, bits):
        flags = unpacked(packed)
        row[:] = flags[grams] / np.sqrt(max(1, flags.sum(dtype=np.int64)))
    marks = x[chosen].T.astype(np.float64)
    values, vectors = np.linalg.eigh(marks.T @ marks)
    keep = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([x @ marks.astype(np.float32) @ root, np.ones((len(x), 1))])
    share = np.bincount(y, minlength=len(names))
    weight = (len(y) / (len(names) * share))[y][:, None]  # languages weigh alike
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    ridge = RIDGE * len(y) * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    w = np.linalg.solve(z.T @ (weight * z) + ridge, z.T @ (weight * target))
    return Model(names, grams, marks.astype(np.float32), np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    """One-versus-rest outputs, a row for each text."""
    x = np.empty((len(texts), len(model.grams)), np.float32)
    for row, flags in zip(x, presence(texts)):
        row[:] = flags[model.grams]
        row /= np.sqrt(max(1, np.count_nonzero(flags)))
    return (x @ model.landmarks) @ model.weights[:-1] + model.weights[-1]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_texts: int) -> tuple[list[str], list[bytes]]:
    """Packed presence vectors of at most about ``train_texts`` labelled texts, equally many of each language and, if there are so many, LEAST_TEXTS.

    The sample goes by a hash of the id; texts stay on the executors, 33 KB a text come back.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("x"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return [], []
    each = max(LEAST_TEXTS, train_texts // len(counts))
    space = 1 << 30
    hashed = F.pmod(F.xxhash64("i", "x"), F.lit(space))
    below = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(space, -(-space * each // n))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            packed = [np.packbits(flags).tobytes() for flags in presence(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["h", "lang", "bits"])

    sample = rows.select(hashed.alias("h"), "x", "lang").where(F.col("h") < below[F.col("lang")])
    with batches_of(docs.sparkSession, BATCH_ROWS):
        got = sample.mapInArrow(run, "h bigint, lang string, bits binary").orderBy("h", "lang", "bits").limit(2 * each * len(counts)).collect()
    return [r["lang"] for r in got], [bytes(r["bits"]) for r in got]


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """The columns of ``docs`` and ``lang_pred, score``, predicted from the whole text alone.

    ``train`` gives the labelled rows. Null texts and texts without a letter, and all texts if
    nothing was learned, are ``und`` with score 0. Ties go to the language that sorts first.
    Columns of ``docs`` named as the new ones are replaced. Null ids and repeated rows stay. The
    session's Arrow batches are short from now on, for the frame runs later.
    """
    langs, bits = training_sample(train, id_col, text_col, lang_col, train_texts)
    model = fit(langs, bits) if langs else None
    del bits
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    where = kept.index(text_col)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    sent = spark.sparkContext.broadcast(model)  # n-grams of LANDMARKS texts x LANDMARKS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED):
                batch = whole.slice(start, SCORED)
                texts = batch.column(where).to_pylist()
                pred, conf = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rows = [i for i, x in enumerate(texts) if has_letter(x)] if model else []
                if rows:
                    out = score(model, [texts[i].encode() for i in rows])
                    top = out.argmax(axis=1)
                    conf[rows] = np.clip((out[np.arange(len(rows)), top] + 1) / 2, 0, 1)
                    for i, k in zip(rows, top):
                        pred[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(conf)], schema.names)

    small_batches(spark)
    return docs.select(*kept).mapInArrow(run, schema)
