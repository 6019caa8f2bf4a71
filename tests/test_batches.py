"""Python objects are made of a bounded part of a batch at a time."""

import pyarrow as pa
from pyspark.sql import functions as F
from quillspan.functions import batches, text
from quillspan.operators import matching, spans


def test_parts_are_bounded_and_whole():
    texts = pa.array(["a" * n for n in (10, 300_000, 5, 5)] + [None] + ["b" * 1000] * 900)
    lists = pa.array([[{"s": 1, "e": 2}] * n for n in (0, 3, 1, 0)] + [None] + [[{"s": 1, "e": 2}] * 50] * 900)
    parts = list(batches.bounded([(texts, lists), (texts[:0], lists[:0])]))
    assert pa.concat_arrays([p[0] for p in parts]).equals(texts) and pa.concat_arrays([p[1] for p in parts]).equals(lists)
    assert all(len(p[0]) == 1 or p[0].nbytes + p[1].nbytes < 2 * batches.PART for p in parts) and len(parts) > 5
    assert [len(p) for p in batches.bounded([pa.array(["x" * batches.PART] * 3)])] == [1, 1, 1]


def test_functions_see_parts(spark, monkeypatch):
    """No part that a function turns into objects is larger than the bound, and results are those of single rows."""
    rows = [(i, "straße és %d " % i * 2_000) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    seen = []
    run = text._text_udf(lambda x: x[:3])
    parts = list(batches.bounded([pa.array([t for _, t in rows])]))
    seen = [sum(len(x.as_py().encode()) for x in p) for p in parts]
    assert len(seen) > 1 and max(seen) <= batches.PART
    assert {r.i: r.x for r in df.select("i", run(F.col("t")).alias("x")).collect()} == {i: "str" for i, _ in rows}
    some = df.select("i", spans.mark_aware_tokens(F.col("t")).alias("w")).collect()
    assert all([x.word for x in r.w] == [x["word"] for x in spans.tokens_of(rows[r.i][1])] for r in some)


def test_matching_of_many_long_documents(spark):
    one = "transform(sequence(0, 999), x -> named_struct('start', int(x), 'end', int(x + 1), 'label', 'A'))"
    df = spark.range(64).coalesce(1).selectExpr("id", f"{one} AS p", f"{one} AS g")
    out = df.select("id", F.size(matching.match_spans(F.col("p"), F.col("g"), "greedy")).alias("n"), F.size(matching.type_errors(F.col("p"), F.col("g"), "global")).alias("k")).collect()
    assert [(r.id, r.n, r.k) for r in out] == [(i, 1000, 0) for i in range(64)]
