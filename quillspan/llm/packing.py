"""Packing into length buckets that minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, numbered

BUCKETS, TOKEN_BUDGET = 16, 65_536


def words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """Upper lengths of at most k buckets with the least padding, by dynamic programming.

    lengths ascend. cost(i, j) pads everything in (i, j] to lengths[j]. Rows of the table are filled by
    divide and conquer, as the best split moves up with j. Ties take the lower split."""
    n = len(lengths)
    if not n:
        return []
    value = np.array(lengths, np.float64)
    rows = np.concatenate(([0.0], np.cumsum(np.array(counts, np.float64))))
    best = value * rows[1:]  # padded tokens of the first j+1 cells in one bucket
    splits = []
    for _ in range(min(k, n) - 1):
        new, split = best.copy(), np.full(n, -1)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            low, high, least, most = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            at = np.arange(least, min(mid - 1, most) + 1)
            pick = least
            if len(at):
                cost = best[at] + value[mid] * (rows[mid + 1] - rows[at + 1])
                pick = int(at[np.argmin(cost)])
                if (found := cost.min()) < new[mid]:
                    new[mid], split[mid] = found, pick
            stack += [(low, mid - 1, least, pick), (mid + 1, high, pick, most)]
        splits.append(split)
        best = new
    uppers, j = [], n - 1
    for split in reversed(splits):
        uppers.append(lengths[j])
        if split[j] < 0:
            continue
        j = int(split[j])
    uppers.append(lengths[j])
    return sorted(set(uppers))


def length_buckets(lengths: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    """Bucket bounds for a column of lengths from its whole histogram, one cell per distinct length.

    d distinct lengths need d * d / 2 words at least, so the driver holds about the square root of the
    input. Null lengths count for nothing."""
    cells = lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("cell")).count().collect()
    cells.sort()
    return best_boundaries([c[0] for c in cells], [c[1] for c in cells], buckets)


def pack(df: DataFrame, key: str = "doc_id", length: Column | None = None, text: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Per row: key, n_tokens, bucket, bucket_tokens, batch, batch_slot and padding.

    A bucket's batches hold budget // bucket_tokens rows, one at least; only the last one of a bucket may
    hold fewer. A row longer than the budget is a batch alone in effect, never cut. Empty and null texts
    have length 0. Repeated rows are packed each; ties on key and length are interchangeable; a null key
    is a value like others. An empty table gives an empty result; other columns are left behind."""
    sizes = checkpoint(df.select(F.col(key), (words(F.col(text)) if length is None else length).alias("n_tokens")))
    bounds = length_buckets(sizes, "n_tokens", buckets)
    bucket, bound = F.lit(0), F.lit(bounds[0] if bounds else 0)
    for i, upper in enumerate(bounds[1:], 1):
        bucket = F.when(F.col("n_tokens") > bounds[i - 1], i).otherwise(bucket)
        bound = F.when(F.col("n_tokens") > bounds[i - 1], upper).otherwise(bound)
    placed = sizes.withColumns({"bucket": bucket.cast("int"), "bucket_tokens": bound.cast("long")})
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    out = numbered(placed, ["bucket"], [F.col(key), F.col("n_tokens")], "_slot").withColumn("_per", per)
    return out.select(key, "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_slot") / F.col("_per")).cast("long").alias("batch"), F.pmod("_slot", "_per").cast("long").alias("batch_slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
