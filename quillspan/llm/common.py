"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of the distributed numbering; the offset table has at most groups x this many rows.
NUMBERING_BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named a local one is made, but only if
    the session runs in this one process; on a cluster that is an error, as executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"file://{tempfile.mkdtemp(prefix='quillspan-')}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Memo(dict):
    """A bounded memo table of two generations: when the young one is full it becomes the old one.

    Keys longer than max_key (0: keys have no length) are computed afresh each time, so memory stays
    bounded by cap."""

    def __init__(self, fn: Callable, cap: int = 250_000, max_key: int = 48):
        super().__init__()
        self.fn, self.cap, self.max_key, self.old = fn, cap, max_key, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if self.max_key and len(key) > self.max_key:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.cap:
            self.old = self.copy()
            self.clear()
        self[key] = value


def beside(df: DataFrame, new: Column) -> DataFrame:
    """Two structs: `row` with the columns of df, and `new`. No column name of a user can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), new.alias("new"))


def kept(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of df out of beside(), without those that are replaced."""
    return [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in {r.lower() for r in replaced}]


def slices(n: int, sizes, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges over n rows whose sizes add up to about budget, one row at least."""
    start = total = 0
    for i in range(n):
        if total and total + sizes[i] > budget:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    if start < n:
        yield start, n


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str, buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """Add `name`: a gapless number from 0 within each group, without putting a group into one task.

    Rows are dealt to (group, hash bucket) cells; cell counts (at most groups x buckets rows, a bound
    that does not depend on the rows) give each cell's first number, and a window numbers each cell.
    Rows that tie on every order column are interchangeable."""
    cell, first = f"_{name}_cell", f"_{name}_first"
    df = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col(cell).alias("_o_cell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*groups, cell).orderBy(*order)
    on = F.col(cell) == F.col("_o_cell")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    out = df.withColumn("_rn", F.row_number().over(within) - 1).join(F.broadcast(offsets), on, "left")
    return out.withColumn(name, (F.col(first) + F.col("_rn")).cast("long")).drop(cell, "_o_cell", first, "_rn", *[f"_o_{g}" for g in groups])
