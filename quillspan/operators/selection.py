"""Sampling, few-shot choice, prefix budgets and split-priority deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import latest_by, running_total


def seeded_order(key: Column, seed: str) -> Column:
    """A shuffle that depends on the seed and the key alone."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def label_cover(df: DataFrame, group: list[str], label: str, order: str, n: int) -> DataFrame:
    """n rows in order, rows that first show a label of their group going before others.

    A greedy pass takes a row exactly if it is the first with some label, so the first rows per label
    and then the rest in order are the same rows."""
    first = latest_by(df, [*group, label], [F.col(order)]).select(order).withColumn("covers", F.lit(0))
    ranked = df.join(first, order, "left").withColumn("covers", F.coalesce("covers", F.lit(1)))
    return ranked.orderBy("covers", order).limit(n).drop("covers")


def prefix_budget(df: DataFrame, groups: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group in a whole-number order until the sum of sizes would first pass the budget."""
    return running_total(df, groups, order, size, "used").where(F.col("used") <= budget)


def split_priority(df: DataFrame, split: str, ranks: dict[str, int], digest: Column, order: Column) -> DataFrame:
    """Add `rank_in_group` (1: the row that stays) and `copies`: of rows with one digest the split of
    lowest rank wins, then the order.

    Groups are reduced to their best row before rows are shuffled whole: only digest, rank and order
    take part in the aggregation, and the join back splits where a digest is hot."""
    rank = F.lit(len(ranks))
    for name, r in ranks.items():
        rank = F.when(F.col(split) == name, r).otherwise(rank)
    keyed = df.withColumns({"digest": digest, "_order": F.struct(rank.alias("r"), order.alias("o"))})
    best = keyed.groupBy("digest").agg(F.min("_order").alias("_best"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(best, "digest").withColumn("stays", F.col("_order") == F.col("_best")).drop("_order", "_best")


def first_per_digest(df: DataFrame, split: str, ranks: dict[str, int], digest: Column, order: str) -> DataFrame:
    """digest, split and order of the row that stays of each digest: one aggregation of small values."""
    rank = F.lit(len(ranks))
    for name, r in ranks.items():
        rank = F.when(F.col(split) == name, r).otherwise(rank)
    best = F.min(F.struct(rank.alias("r"), F.col(order), F.col(split))).alias("b")
    return df.groupBy(digest.alias("digest")).agg(best).select("digest", f"b.{split}", f"b.{order}")
