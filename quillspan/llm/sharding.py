"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


def _score(keys: list[Column], shard: int, weight: float) -> Column:
    """-ln(u) / weight with u uniform in (0, 1) from the hash of key and shard; the least score wins."""
    u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(keys: list[Column], weights: Mapping[int, float]) -> Column:
    """The shard of a record: its key, the shards and their weights decide, nothing else.

    A shard of weight 0 gets no rows. Adding a shard or raising its weight moves rows only into it;
    removing one moves only its own rows. Null keys hash like a value of their own."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a weight above 0")
    scores = [F.struct(_score(keys, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(live.items())]
    return F.array_min(F.array(*scores))["shard"]


def equal_weights(n: int) -> dict[int, float]:
    return dict.fromkeys(range(n), 1.0)


def assign_shards(df: DataFrame, key: str, n_shards: int, text_col: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 bytes of the text plus 1 (null text: 1); text_crc32 is 0 for a null text. slot
    numbers the rows of a shard from 0 without gaps; rows that tie on key, size and checksum are
    interchangeable. Only these few columns are shuffled, never texts. Repeated rows have slots of
    their own; an empty table gives an empty result; other columns are left behind."""
    keys = [F.col(key)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(keys, equal_weights(n_shards)).alias("shard"),
        rendezvous(keys, equal_weights(n_shards + 1)).alias("grown_shard"),
    )
    out = numbered(rows, ["shard"], [F.col(key), F.col("size"), F.col("text_crc32")], "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
