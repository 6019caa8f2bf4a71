"""Relational helpers that several queries share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which should be total.

    A rank filter: Spark prunes each task's rows to n per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_text(column: str, text: str | None, wildcards: bool = False) -> Column:
    """A search condition; an empty text matches all. With wildcards, % and _ keep their LIKE meaning."""
    if not text:
        return F.lit(True)
    return F.col(column).like(f"%{text}%") if wildcards else F.col(column).contains(text)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page (from 1; 1 to 100 rows) with the total row count in each row.

    The total is one aggregate joined to a top-k, so the rows are never gathered in one window."""
    size, number = min(max(size, 1), 100), max(number, 1)
    top = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return top.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column], rules: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Rows of the target with the updates merged in by key.

    Of several updates with one key the first in `order` counts. A new key takes the update's values.
    For a known key a column takes rules[column](old, new), or the new value where it has no rule. As
    parquet tables cannot be merged in place, the result is the whole new table."""
    rules = rules or {}
    new = latest_by(updates, keys, order).select(*target.columns)
    old = target.select(*[F.col(c).alias(f"_old_{c}") for c in target.columns], F.lit(True).alias("_known"))
    new = new.withColumn("_new", F.lit(True))
    on = all_of([F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys])
    both = old.join(new, on, "full_outer")

    def value(c: str) -> Column:
        was, now = F.col(f"_old_{c}"), F.col(c)
        merged = rules[c](was, now) if c in rules else now
        return F.when(F.col("_new").isNull(), was).when(F.col("_known").isNull(), now).otherwise(merged).alias(c)

    return both.select(*[value(c) for c in target.columns])


def keep_old(old: Column, new: Column) -> Column:
    return old


def keep_known(old: Column, new: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def replace_by_key(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the target whose key is not in `fresh`, and the rows of `fresh`."""
    return target.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def append_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the target does not have yet by key: what an idempotent append writes."""
    return rows.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def _in_cells(df: DataFrame, groups: list[str], order: str, cell: int, end: Column, before: Callable[[Column], Column]) -> DataFrame:
    """df with _cell (a range of a whole-number order) and _before: what the cells before it leave.

    `end` is aggregated to one row per group and cell; only those rows meet in one window, so a group
    of any size is dealt to many tasks."""
    cells = df.withColumn("_cell", F.floor(F.col(order) / cell))
    ends = cells.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_cell").alias("_c")).agg(end.alias("_end"))
    w = Window.partitionBy(*[f"_g_{g}" for g in groups]).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", before(F.col("_end")).over(w)).drop("_end")
    on = all_of([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col("_cell").eqNullSafe(F.col("_c"))])
    return cells.join(ends, on).drop("_c", *[f"_g_{g}" for g in groups])


def running_total(df: DataFrame, groups: list[str], order: str, size: Column, name: str, cell: int = 4096) -> DataFrame:
    """Add the sum of sizes of a group's rows up to each row in a whole-number order without ties."""
    sized = df.withColumn("_size", size)
    placed = _in_cells(sized, groups, order, cell, F.sum("_size"), F.sum)
    w = Window.partitionBy(*groups, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum("_size").over(w)).drop("_cell", "_before", "_size")


def previous_value(df: DataFrame, groups: list[str], order: str, value: str, name: str, cell: int = 4096) -> DataFrame:
    """Add the value of the row before each row of its group in a whole-number order without ties."""
    placed = _in_cells(df, groups, order, cell, F.max_by(value, order), lambda c: F.last(c))
    w = Window.partitionBy(*groups, "_cell").orderBy(order)
    first = F.row_number().over(w) == 1
    return placed.withColumn(name, F.when(first, F.col("_before")).otherwise(F.lag(value).over(w))).drop("_cell", "_before")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir. Where none is named a local folder
    serves a session of one process; on a cluster that is an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspan-ckpt-"))
    return df.checkpoint()


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node and depth of all nodes that up to `depth` edges (a, b) reach from the nodes of `start`.

    Breadth first: a level joins only its frontier, and each frontier is a checkpoint, so plans stay
    flat. It ends early when a frontier is empty."""
    frontier = cut(start.select("node", F.lit(0).alias("depth")))
    seen = frontier
    for level in range(1, depth + 1):
        new = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
