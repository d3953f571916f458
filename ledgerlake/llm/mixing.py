"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares p of the sources are raised to a power alpha in [0, 1] and normalised. Bisection
finds the power: the largest one whose weights reach a target entropy, raised further until no
source repeats more often than allowed. Weights are then realised over a token budget: every
source is gone through in whole passes and one part of a pass, each pass a permutation of
blocks of its documents.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlake.llm.common import fresh, staged

#: Documents that a block holds on average: what one task orders.
BLOCK_DOCS = 4096
#: Sources whose totals the driver holds; there are few sources, and more of them is an error.
MAX_SOURCES = 100_000


class Plan(NamedTuple):
    alpha: float
    weights: dict
    quotas: dict
    budget: int


def weights_at(tokens: dict, alpha: float) -> dict:
    """Normalised p^alpha over the sources that have tokens."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** alpha for s, n in tokens.items() if n > 0}
    whole = sum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_down(holds, low: float = 0.0, high: float = 1.0) -> float:
    """The largest x of [low, high] for which ``holds``, given that it holds up to some x and not beyond."""
    if holds(high):
        return high
    if not holds(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def passes_needed(tokens: dict, weights: dict) -> float:
    """Tokens of the smallest budget in which every source is gone through once at least."""
    return max(tokens[s] / w for s, w in weights.items())


def plan(tokens: dict, target_entropy: float = 0.98, max_repeats: float = 2.0, budget: int | None = None) -> Plan:
    """Power, weights and token quotas of the sources.

    ``target_entropy`` is a share of the largest possible entropy. Without a budget the
    smallest one is taken in which no document is lost. ``max_repeats`` limits passes of any
    source; the power rises towards 1 (the shares as they are) until it holds.
    """
    known = {s: n for s, n in tokens.items() if n > 0}
    if not known:
        return Plan(1.0, {}, {s: 0 for s in tokens}, 0)
    wanted = target_entropy * math.log(len(known)) - 1e-12
    alpha = bisect_down(lambda a: entropy(weights_at(known, a)) >= wanted)

    def too_often(a: float) -> bool:
        w = weights_at(known, a)
        size = passes_needed(known, w) if budget is None else budget
        return max(w[s] * size / known[s] for s in w) > max_repeats + 1e-9

    if too_often(alpha) and not too_often(1.0):
        alpha = max(alpha, 1.0 - bisect_down(lambda back: not too_often(1.0 - back), 0.0, 1.0 - alpha))
    weights = weights_at(known, alpha)
    size = math.ceil(passes_needed(known, weights) - 1e-6) if budget is None else budget
    quotas = {s: min(round(weights[s] * size), math.floor(max_repeats * known[s])) if s in weights else 0 for s in tokens}
    if budget is None:
        quotas = {s: max(q, tokens[s]) for s, q in quotas.items()}
    return Plan(alpha, weights, quotas, size)


def token_length(text) -> F.Column:
    """Words of a text, split at ASCII white space; null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_entropy: float = 0.98, max_repeats: float = 2.0, budget: int | None = None, seed: int = 0,
) -> DataFrame:
    """The drawn documents: ``doc_id, source, n_tokens, h, pass, block, slot, weight, alpha, entropy, reached``, one row per draw.

    ``pass, block, slot`` order the draws of a source: blocks by number, documents by their place in
    the block. ``h`` is a hash of the text. ``alpha`` is the power, ``entropy`` that of the weights, and
    ``reached`` tells whether it is the target or more. A source's share of the tokens drawn is its
    weight but for the last document of its part pass, for documents that are never lost and for
    ``max_repeats``, which may keep a given budget from being met.

    Pass 0 to k-1 hold all documents of a source, pass k those whose permuted blocks come
    before its quota is reached. Null sources are a source of their own. Documents without
    words cost nothing: they come with every whole pass. Null ids and repeated rows count as
    they are. Sources without any token keep their documents once.
    """
    lengths = staged(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_length(text_col).alias("n_tokens"), F.xxhash64(F.col(text_col)).alias("h")),
        "lengths",
    )
    totals = lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: r["tokens"] for r in totals}
    drawn = plan(tokens, target_entropy, max_repeats, budget)
    rows = []
    for r in totals:
        s, n = r["source"], r["tokens"]
        whole = drawn.quotas[s] // n if n else 1
        rows.append((s, drawn.weights.get(s, 0.0), whole, drawn.quotas[s] - whole * n if n else 0, max(1, r["docs"] // BLOCK_DOCS)))
    spark = docs.sparkSession
    table = spark.createDataFrame(rows, "src string, weight double, whole bigint, rest bigint, blocks bigint")
    at = lengths.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("src"))).drop("src")  # at most MAX_SOURCES rows
    # A part of a pass: its own permutation of the documents into blocks, and of the blocks.
    order = lambda number: F.xxhash64(F.lit(seed), number, "doc_id", "h")
    blocked = at.withColumn("o", order(F.col("whole"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "o"), F.col("blocks")))
    sums = blocked.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("src"), F.col("block").alias("b"), F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("before"), "in_block")
    dealt = blocked.where("rest > 0").join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("block") == F.col("b"))).drop("src", "b")
    inside = dealt.where("before + in_block <= rest")
    running = Window.partitionBy("source", "block").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = dealt.where("before < rest and before + in_block > rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where("upto <= rest").drop("upto")
    part = inside.unionByName(edge).select("doc_id", "source", "n_tokens", "h", F.col("whole").alias("pass"), "block", "o", "weight")
    full = at.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("pass"))
    full = full.withColumn("o", order(F.col("pass"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "o"), F.col("blocks")))
    drawn_rows = full.select("doc_id", "source", "n_tokens", "h", "pass", "block", "o", "weight").unionByName(part)
    slot = F.row_number().over(Window.partitionBy("source", "pass", "block").orderBy("o", "doc_id")) - 1
    reached = entropy(drawn.weights) >= target_entropy * math.log(max(1, len(drawn.weights))) - 1e-9
    facts = [F.lit(drawn.alpha).alias("alpha"), F.lit(entropy(drawn.weights)).alias("entropy"), F.lit(reached).alias("reached")]
    return drawn_rows.select("doc_id", "source", "n_tokens", "h", "pass", "block", slot.cast("bigint").alias("slot"), "weight", *facts)


def realise(docs: DataFrame, draws: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as it was drawn, with the columns they came with, whatever their names and types.

    Draws are counted per id and text. Rows that repeat both share their draws: the whole
    passes evenly, so that none is lost.
    """
    one, h, times, many, each, copy = (fresh(x, docs) for x in ("id_", "h_", "times_", "alike_", "each_", "copy_"))
    drawn = draws.groupBy(F.col("doc_id").alias(one), F.col("h").alias(h)).agg(F.count(F.lit(1)).alias(times))
    text_hash = F.xxhash64(F.col(text_col))
    key = F.col(id_col).cast("bigint")
    other, g = one + "_", h + "_"
    alike = docs.groupBy(key.alias(other), text_hash.alias(g)).agg(F.count(F.lit(1)).alias(many))
    share = drawn.join(alike, F.col(one).eqNullSafe(F.col(other)) & (F.col(h) == F.col(g))).select(one, h, F.ceil(F.col(times) / F.col(many)).cast("int").alias(each))
    out = docs.join(share, key.eqNullSafe(F.col(one)) & (text_hash == F.col(h)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*docs.columns)
