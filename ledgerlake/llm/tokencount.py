"""Greedy word-piece token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where longest-match cannot go on from a node, the
link leads to the node that stands for what is left after the pieces already certain are taken,
and ``popped`` holds how many pieces those are. One pass over the bytes of a word then gives
the number of pieces that greedy longest-match-first takes, without building a piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a worker remembers; older ones are forgotten together.
REMEMBERED_WORDS = 400_000

_built: dict[bytes, "WordPieceCounter"] = {}


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: a base64 piece and a number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class WordPieceCounter:
    """Counts pieces of words. A word is looked up with one space before it, as the vocabulary writes word starts."""

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}
        final = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                node = step.get(key, 0)
                if not node:
                    node = step[key] = len(final)
                    final.append(False)
            final[node] = node > 0
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, node in step.items():
            children[key >> 8].append((key & 255, node))
        fail, popped = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for byte, node in children[at]:
                queue.append(node)
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                back, taken = fail[at], popped[at]
                while back >= 0 and (back << 8 | byte) not in step:
                    taken += popped[back]
                    back = fail[back]
                if back >= 0:
                    fail[node], popped[node] = step[back << 8 | byte], taken
        self.step, self.fail, self.popped = step, fail, popped
        self.known: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> int:
        """Pieces of one word; 1 (an unknown token) if the vocabulary cannot spell it."""
        step, fail, popped = self.step, self.fail, self.popped
        at, total = 0, 0
        for byte in b" " + word:
            while (node := step.get(at << 8 | byte)) is None:
                if fail[at] < 0:
                    return 1
                total += popped[at]
                at = fail[at]
            at = node
        while at:
            if fail[at] < 0:
                return 1
            total += popped[at]
            at = fail[at]
        return total

    def count(self, text: bytes) -> tuple[int, int]:
        """Pieces and words of a text; words are split at ASCII white space."""
        words, known = text.split(), self.known
        total = 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.pieces(word)
                if len(word) <= 64:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total, len(words)


def counter(pieces: list[bytes]) -> WordPieceCounter:
    """The automaton of a vocabulary, built once in each worker process."""
    content = hashlib.sha256()
    for piece in pieces:
        content.update(len(piece).to_bytes(4, "big") + piece)
    key = content.digest()
    if key not in _built:
        _built.clear()
        _built[key] = WordPieceCounter(pieces)
    return _built[key]


def token_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_words, n_bytes`` of every row's whole text.

    Null and empty texts have zero tokens. A word that the vocabulary cannot spell counts as
    one unknown token. Repeated rows and null ids come out as they are; other columns are ignored.
    """
    if not any(vocabulary):
        raise ValueError("the vocabulary is empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = counter(vocabulary)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            found = [auto.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64()), pa.array([len(x) for x in texts], pa.int64())],
                ["doc_id", "n_tokens", "n_words", "n_bytes"],
            )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(texts.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_words bigint, n_bytes bigint"), "token-counts")
