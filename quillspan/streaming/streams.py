"""Streaming forms of operators whose state is natural: rate limits, deduplication, latest rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import upsert

LIMIT, SECONDS = 5, 900


def rate_limit(failures: DataFrame, key: str, at: str, limit: int = LIMIT, seconds: int = SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Per failure: key, at, attempts (of the last `seconds`, this one too) and blocked (attempts > limit).

    State is the epoch seconds inside the window, so it is bounded by the rate; a key's state goes when
    the watermark has passed its last failure by that long. A batch's rows are taken in order of time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(at, kind="stable")
        attempts = []
        for t in rows[at].astype("datetime64[s]").astype("int64").tolist():
            recent = [x for x in recent if t - seconds <= x <= t] + [t]
            attempts.append(len(recent))
        state.update((recent,))
        state.setTimeoutTimestamp(max((max(recent) + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key], at: rows[at], "attempts": attempts, "blocked": [a > limit for a in attempts]})

    types = dict(failures.dtypes)
    out = f"{key} {types[key]}, {at} {types[at]}, attempts bigint, blocked boolean"
    return failures.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, out, "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def new_fingerprints(qa: DataFrame, at: str, delay: str = "1 hour", question: str = "question", answer: str = "answer") -> DataFrame:
    """Question-answer pairs not seen before within the delay, by fingerprint."""
    keyed = qa.withColumn("fingerprint", F.sha2(F.concat(F.lower(question), F.lit("\n"), F.lower(answer)), 256))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def event_counts(events: DataFrame, at: str, kind: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling-window counts of a kind of event, with late rows up to the delay."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def latest_into(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row per key in a parquet table.

    Keys are dealt to buckets; a batch reads and writes only the buckets that it touches, each as a new
    version. A failed batch leaves the versions before it whole, and a batch that is run again overwrites
    its own. latest_rows() reads the table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # at most `buckets` numbers
        known = latest_rows(spark, path, touched, number)
        every = placed if known is None else known.unionByName(placed)
        rows = upsert(every.limit(0), every, keys, [F.desc(c) for c in order])
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")

    return merge


def latest_rows(spark: SparkSession, path: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows of a table of latest_into(), with their bucket, or None if nothing was written yet.

    Of each bucket (of these) the highest version (below `before`) counts; versions and buckets are folder
    names, so only the files of those are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for version in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/bucket=*")) or []:
        folder = version.getPath()
        number, bucket = int(folder.getParent().getName()[8:]), int(folder.getName()[7:])
        if (before is None or number < before) and (buckets is None or bucket in buckets):
            newest[bucket] = max(newest.get(bucket, (-1, "")), (number, folder.toString()))
    if not newest:
        return None
    parts = [spark.read.parquet(folder).withColumn("bucket", F.lit(bucket)) for bucket, (_, folder) in sorted(newest.items())]
    return reduce(DataFrame.unionByName, parts)
