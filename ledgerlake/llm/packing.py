"""Packing into optimal length buckets.

Dynamic programming over the histogram of all lengths chooses the bucket boundaries that
minimise padding; inside each bucket documents are dealt into batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged
from ledgerlake.llm.mixing import token_length

#: Documents of a bucket that one task deals into batches.
SHARD_DOCS = 20_000


def best_boundaries(cells: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding.

    ``cells``: (length, documents) of every length that occurs, ascending. Padding of a bucket is
    the sum over its documents of its upper end less their length. The best last cut never moves
    down as the end moves up, so each round halves ranges of ends and of cuts: n log n steps. Ties:
    fewer buckets, then lower ends.
    """
    if not cells:
        return []
    ends, counts = (np.array(x, np.float64) for x in zip(*cells))
    n = np.concatenate([[0.0], np.cumsum(counts)])
    t = np.concatenate([[0.0], np.cumsum(counts * ends)])
    size = len(ends)
    best = ends * n[1:] - t[1:]
    back, totals = [np.full(size, -1)], [best[-1]]
    for _ in range(1, min(buckets, size)):
        cost, cut = np.full(size, np.inf), np.zeros(size, np.int64)
        ranges = [(1, size - 1, 0, size - 2)]
        while ranges:
            low, high, first, last = ranges.pop()
            if low > high:
                continue
            j = (low + high) // 2
            stop = min(j - 1, last) + 1
            each = best[first:stop] + ends[j] * (n[j + 1] - n[first + 1 : stop + 1]) - (t[j + 1] - t[first + 1 : stop + 1])
            i = int(np.argmin(each))
            cost[j], cut[j] = each[i], first + i
            ranges += [(low, j - 1, first, first + i), (j + 1, high, first + i, last)]
        gain = cost < best
        back.append(np.where(gain, cut, -2))
        best = np.where(gain, cost, best)
        totals.append(best[-1])
    level, j, out = int(np.argmin(totals)), size - 1, []
    while j >= 0:
        out.append(int(ends[j]))
        while back[level][j] == -2:  # no gain from this many buckets
            level -= 1
        j = int(back[level][j])
        level -= 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, token_budget: int = 65_536, tokens: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_tokens, batch_id, slot, padding`` for every row.

    A batch holds as many documents as fit its budget when each is padded to the bucket's upper
    end, one at least: a document longer than the budget is a batch of its own. Null and empty
    texts have length 0 and go to the shortest bucket. ``tokens`` may give lengths, as from ``token_counts``;
    else words count. Null ids and repeated rows take slots
    of their own; other columns are ignored. An empty table gives no rows.
    """
    length = token_length(text_col) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")
    lengths = staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), length.alias("n_tokens"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("o")), "lengths")
    # The histogram of all lengths: a row for each length that occurs, however many documents there are.
    cells = sorted((r["n_tokens"], r["docs"]) for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).collect())
    ends = best_boundaries(cells, buckets)
    held = [sum(n for top, n in cells if low < top <= high) for low, high in zip([-1, *ends], ends)]
    spark = docs.sparkSession
    table = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(e).cast("bigint").alias("end"), F.lit(max(1, -(-h // SHARD_DOCS))).cast("bigint").alias("shards")) for i, (e, h) in enumerate(zip(ends, held))]) if ends else None
    if table is None:
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint, bucket int, bucket_tokens bigint, batch_id string, slot bigint, padding bigint")
    placed = lengths.withColumn("b", F.filter(table, lambda x: x["end"] >= F.col("n_tokens"))[0]).select("doc_id", "n_tokens", "o", "b.bucket", F.col("b.end").alias("end"), F.pmod("o", F.col("b.shards")).alias("shard"))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("o", "doc_id")) - 1)
    fit = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(token_budget) / F.greatest(F.col("end"), F.lit(1))).cast("bigint"))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", F.col("end").alias("bucket_tokens"),
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("n") / fit)).alias("batch_id"),
        F.pmod(F.col("n"), fit).cast("bigint").alias("slot"), (F.col("end") - F.col("n_tokens")).alias("padding"),
    )
