"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, checkpoint, kept, slices

#: Every tree is grown on all good labelled rows, to this depth at most.
TREES, DEPTH, SEED = 100, 8, 7
#: Parts that the range of the threshold is divided into in one pass.
BINS = 1024
#: Share of good labelled rows that the threshold may reject.
GOOD_LOSS = 0.001
#: How far splits may fall outside a node's rows, as a share of a statistic's range over the labelled rows.
MARGIN = 0.1
WINDOW, BATCH_BYTES = 8, 8 << 20
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_FIELDS = pa.struct([(n, pa.int64()) for n in STATS])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; hashing is faster than looking words up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words; one of a text shorter than that has none."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : len(hashes) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    windows = window_hashes(hashes, width)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[: len(windows)] += found
    steps[width:] -= found
    return int((np.cumsum(steps) > 0).sum())


def statistics(texts: list[bytes | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {n: [] for n in STATS}
    for data in texts:
        data = data or b""
        words = data.split()  # of bytes: splits at exactly 0x20 and 0x09-0x0D
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeated = repeated_words(word_hashes(words)) if len(words) > WINDOW else 0
        joined = b"".join(words)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(joined.decode()))
        out["n_symbols"].append(len(joined) - len(joined.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated)
        out["n_lines"].append(len(lines))
    return out


def rule_statistics(text: Column) -> Column:
    """Struct of STATS for a text; null counts as empty. Words are runs without ASCII white space."""

    @F.arrow_udf(",".join(f"{n}:bigint" for n in STATS).join(("struct<", ">")))
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [statistics(part.to_pylist()) for part in _parts(batch)]
            yield pa.StructArray.from_arrays([pa.array([x for f in found for x in f[n]], pa.int64()) for n in STATS], fields=list(_FIELDS))

    return stats(text)


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    data = batch.cast(pa.binary())
    sizes = [x or 0 for x in pa.compute.binary_length(data).to_pylist()]
    for a, b in slices(len(data), sizes, BATCH_BYTES):
        yield data.slice(a, b - a)


FEATURES = ("word_length", "symbols_per_word", "symbols_per_char", "dup_lines", "repeats")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the rule statistics; length itself is no anomaly."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    x = [s["word_chars"] / words, s["n_symbols"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words]
    return np.stack([np.asarray(v, np.float64) for v in x], axis=1)


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _usual_path(n):
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1: leaf), split, left child (right is the next), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    rows: int
    threshold: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, margin: np.ndarray | float = 0.0, trees: int = TREES, seed: int = SEED) -> IsolationForest:
        """The forest grown on the rows of an array."""
        return cls.grow(lambda forest, first: forest.ranges([x], first, x.shape[1]), margin, trees, seed)

    @classmethod
    def grow(cls, ranges: Callable, margin: np.ndarray | float = 0.0, trees: int = TREES, seed: int = SEED) -> IsolationForest:
        """Random splits; every tree is grown on all rows, a level of all trees at a time.

        ranges(forest, first) counts and bounds the rows in each tree's nodes from number first[tree] on,
        as the method of that name does. A margin lets a split fall beyond a node's rows, so that rows
        outside the range of the fitted ones are isolated early, in a statistic that is constant too."""
        rng = np.random.default_rng(seed)
        forest = cls([_leaves(1) for _ in range(trees)], 0)
        first, level, depth = [0] * trees, 0, 0
        while any(f < len(t[0]) for f, t in zip(first, forest.trees, strict=True)):
            found = zip(*ranges(forest, first), strict=True)
            for t, (feature, split, left, path) in enumerate(forest.trees):
                size, more = len(feature), 0
                for node in range(first[t], size):
                    n, low, high = next(found)
                    if level == 0:
                        forest.rows, depth = int(n), min(DEPTH, max(1, int(np.ceil(np.log2(max(n, 2))))))
                    low, high = low - margin, high + margin
                    wide = np.flatnonzero(high > low)
                    if level >= depth or n < 2 or not len(wide):
                        path[node] = level + float(_usual_path(n))
                        continue
                    f = int(rng.choice(wide))
                    feature[node], split[node], left[node] = f, rng.uniform(low[f], high[f]), size + more
                    more += 2
                first[t] = size
                forest.trees[t] = tuple(np.concatenate(both) for both in zip((feature, split, left, path), _leaves(more), strict=True))
            level += 1
        return forest

    def nodes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the leaf that each row falls into."""
        for feature, split, left, _ in self.trees:
            node = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                f = feature[node[live]]
                live = live[f >= 0]
                at = node[live]
                node[live] = left[at] + (x[live, feature[at]] > split[at])
            yield node

    def ranges(self, parts: Iterable[np.ndarray], first: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, least and largest features (inf and -inf: none) of the rows in each tree's nodes from
        number first[tree] on, the trees one after the other."""
        starts = np.cumsum([0] + [len(t[0]) - f for t, f in zip(self.trees, first, strict=True)])
        count, low = np.zeros(starts[-1], np.int64), np.full((starts[-1], width), np.inf)
        high = -low
        for x in parts:
            for node, begin, start in zip(self.nodes(x), first, starts, strict=False):
                here = np.flatnonzero(node >= begin)
                if not len(here):
                    continue
                place = (node[here] - begin).astype(np.uint16)
                order = np.argsort(place, kind="stable")
                place, rows = place[order], x[here[order]]
                heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                at = place[heads] + start
                count[at] += np.diff(np.append(heads, len(place)))
                low[at] = np.minimum(low[at], np.minimum.reduceat(rows, heads))
                high[at] = np.maximum(high[at], np.maximum.reduceat(rows, heads))
        return count, low, high

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for (_, _, _, path), node in zip(self.trees, self.nodes(x), strict=True):
            total += path[node]
        usual = float(_usual_path(self.rows))
        return 2.0 ** -(total / max(len(self.trees), 1) / usual) if usual else np.zeros(len(x))

    def calibrate(self, x: np.ndarray, good: np.ndarray, good_loss: float = GOOD_LOSS) -> IsolationForest:
        """calibrate_by() on the rows of an array."""
        scores = self.score(x)
        ok, bad = np.sort(scores[good]), np.sort(scores[~good])
        return self.calibrate_by(len(ok), lambda n: ok[n - 1], lambda least: next(iter(bad[bad > least]), None), good_loss)

    def calibrate_by(self, n_good: int, nth: Callable, next_bad: Callable, good_loss: float = GOOD_LOSS) -> IsolationForest:
        """The threshold that rejects most bad rows while it rejects good_loss of the good rows at most.

        nth(n) is the n-th least score of the good rows, next_bad(s) the least one of a bad row above s or
        None. Rows at the threshold are kept. Without good rows nothing is rejected."""
        self.threshold = float(nth(int(np.ceil(n_good * (1 - good_loss))))) if n_good else 1.0
        bad = next_bad(self.threshold) if n_good else None
        if bad is not None:  # halfway to the first bad row above it, so that like good rows stay
            self.threshold = (self.threshold + float(bad)) / 2
        return self


def _leaves(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the rows that pass the base rules, and which of them are good."""
    for batch in batches:
        s = {n: batch.column("s").field(n).to_numpy(zero_copy_only=False) for n in STATS}
        use = ~base_failed(s["n_words"], s["n_repeat_words"])
        yield features(s)[use], batch.column("good").to_numpy(zero_copy_only=False).astype(bool)[use]


def _ranges(rows: DataFrame, forest: IsolationForest, first: list[int], every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IsolationForest.ranges() over the good rows of a table, or over every row."""
    width = len(FEATURES)
    names = [f"{side}{i}" for side in ("low", "high") for i in range(width)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = forest.ranges((x if every else x[good] for x, good in _labelled(batches)), first, width)
        some = np.flatnonzero(count)
        columns = [some, count[some], *low[some].T, *high[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", *names])

    found = rows.mapInArrow(part, "node long, n long, " + ", ".join(f"{c} double" for c in names)).groupBy("node")
    got = found.agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in names[:width]], *[F.max(c).alias(c) for c in names[width:]]).toPandas()
    count, low, high = forest.ranges([], first, width)
    at = got["node"].to_numpy(np.int64)
    count[at], low[at], high[at] = got["n"], got[names[:width]], got[names[width:]]
    return count, low, high


def nth_least(df: DataFrame, column: str, n: int) -> float:
    """The n-th least value of a column of doubles, exactly: the bin that holds it is divided into bins
    until it holds one value. At most BINS + 1 rows a pass are collected."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        number = F.floor((F.col(column) - low) / (high - low) * BINS)
        bins = df.where(F.col(column).between(low, high)).groupBy(number.alias("bin"))
        for _, count, low, high in bins.agg(F.count(F.lit(1)), F.min(column), F.max(column)).orderBy("bin").collect():
            if n <= count:
                break
            n -= count
    return low


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> IsolationForest:
    """A forest grown on all good labelled rows, its threshold calibrated on all labelled rows, good and bad.

    Statistics are taken before the join, so no text is shuffled; those of the labelled rows are
    checkpointed and read once for each level of the trees. What is collected is bounded: a row for each
    node of a level (TREES x 2 ** DEPTH at most) and the bins of the threshold. Rows that fail the base
    rules are left out: they never reach the forest."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).select(F.col(key).alias("_k"), (F.col(quality) > 0).alias("good"))
    stats = df.select(F.col(key).alias("_d"), rule_statistics(F.col(text)).alias("s"))
    rows = checkpoint(stats.join(chosen, F.col("_d") == F.col("_k")).select("good", "s"))
    n, low, high = (found[0] for found in _ranges(rows, IsolationForest([_leaves(1)], 0), [0], every=True))
    forest = IsolationForest.grow(lambda forest, first: _ranges(rows, forest, first), MARGIN * (high - low) if n else 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, good in _labelled(batches):
            yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(forest.score(x))], ["good", "score"])

    scores = checkpoint(rows.mapInArrow(score, "good boolean, score double"))
    bad = scores.where("NOT good")
    return forest.calibrate_by(forest.rows, lambda n: nth_least(scores.where("good"), "score", n), lambda least: bad.where(F.col("score") > least).agg(F.min("score")).first()[0])


def _verdict(forest: IsolationForest, stats: Column) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            s = {n: batch.field(n).to_numpy(zero_copy_only=False) for n in STATS}
            yield pa.array(forest.score(features(s)))

    return score(stats)


def quality_rules(df: DataFrame, forest: IsolationForest, text: str = "text") -> DataFrame:
    """Add STATS, base_failed, anomaly (the forest's score) and kept to every row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept is false for
    those, else anomaly <= threshold. Null and empty texts have no words and fail. Whole texts are read,
    however long. Repeated rows get one verdict each; an empty table gives an empty result; columns of
    these names are replaced, others stay."""
    stats = beside(df, rule_statistics(F.col(text)))
    judged = stats.withColumn("anomaly", _verdict(forest, F.col("new")))
    failed = (F.col("new.n_words") < 20) | (100 * F.col("new.n_repeat_words") > 30 * F.col("new.n_words"))
    verdict = ~failed & (F.col("anomaly") <= forest.threshold)
    return judged.select(*kept(df, *STATS, "base_failed", "kept", "anomaly"), *[F.col(f"new.{n}") for n in STATS], failed.alias("base_failed"), verdict.alias("kept"), "anomaly")
