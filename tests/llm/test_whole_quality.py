"""The forest and its threshold come from every labelled row, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspan.llm.quality import MARGIN, STATS, IsolationForest, base_failed, features, fit, quality_rules, statistics


def test_late_labelled_rows_count(spark):
    order = [r.i for r in spark.range(4700).select(F.col("id").alias("i")).orderBy(F.xxhash64("id")).collect()]
    bad, late = set(order[:200]), set(order[4200:])  # good rows with symbols come after the first 4,000
    words = [("###" if i in bad else "#" if i in late else "") + f"w{i}" for i in range(4700)]
    texts = [" ".join(words[i] + "abcdefgh"[: (i * k) % 7] + str(k) for k in range(30)) for i in range(4700)] + ["too short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(4701)] + [(None, 1), (1, None)], "doc_id long, quality int")
    forest = fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules(docs, forest).collect()}
    assert sum(not rows[i].kept for i in range(4700) if i not in bad) <= 4 and not any(rows[i].kept for i in bad)

    stats = {n: np.array(v) for n, v in statistics([t.encode() for t in texts]).items()}
    use = ~base_failed(stats["n_words"], stats["n_repeat_words"])
    x, good = features({n: stats[n] for n in STATS})[use], np.array([i not in bad for i in range(4701)])[use]
    whole = IsolationForest.fit(x[good], MARGIN * (x.max(axis=0) - x.min(axis=0))).calibrate(x, good)
    assert (forest.rows, forest.threshold) == (4500, pytest.approx(whole.threshold, abs=1e-12))
    assert [rows[i].anomaly for i in range(4700)] == pytest.approx(list(whole.score(x)))


def test_every_row_bounds_its_node():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (700, 3))
    forest = IsolationForest.fit(x, trees=4)
    count, low, high = forest.ranges([x[:300], x[300:300], x[300:]], [0] * 4, 3)
    leaves = np.concatenate([np.arange(len(t[0])) for t in forest.trees])
    tree = np.repeat(range(4), [len(t[0]) for t in forest.trees])
    found = list(forest.nodes(x))
    for k, (t, leaf) in enumerate(zip(tree, leaves, strict=True)):
        mine = x[found[t] == leaf]
        assert count[k] == len(mine) and (not len(mine) or (low[k] == mine.min(axis=0)).all() and (high[k] == mine.max(axis=0)).all())
    assert forest.rows == 700 and count.sum() == 4 * 700


@pytest.mark.parametrize("values", [[0.5], [0.25, 0.25, 0.75], [0.1 + 0.2, 0.3, 0.3, 1.0, 5e-324, 0.0], [i / 7919 % 0.37 for i in range(3000)]])
def test_nth_least(spark, values):
    from quillspan.llm.quality import nth_least

    df = spark.createDataFrame([(v,) for v in values], "score double")
    for n in {1, 2, len(values) // 2, len(values) - 1, len(values)} & set(range(1, len(values) + 1)):
        assert nth_least(df, "score", n) == sorted(values)[n - 1]
