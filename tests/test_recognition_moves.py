"""Recognition moves no token before the dictionary is asked, and counts its phrases once."""

from conftest import SMALL
from pyspark.sql import functions as F
from quillspan.operators import ner
from quillspan.plans.ner import Terms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_tested_in_place(spark):
    docs = Terms(spark, SMALL).docs
    keys = spark.createDataFrame([("the",), ("of the",), ("no such run here",)], "key string")
    hits = ner.phrase_hits(docs, keys)
    assert "hashpartitioning" not in plan(hits)
    want = {(r.doc_id, n, i) for r in docs.select("doc_id", F.col("tokens.key").alias("k")).collect() for n, key in ((1, "the"), (2, "of the")) for i in range(len(r.k)) if " ".join(r.k[i : i + n]) == key}
    assert {(r.doc_id, r.n, r.start) for r in hits.where("key IN ('the', 'of the')").collect()} == want and len(want) > 10
    assert hits.count() < 2 * len(want)


def test_phrases_are_counted_once(spark):
    t = Terms(spark, SMALL)
    assert t.phrases is t.phrases and plan(t.phrases).count("Exchange") == 0


def test_tokens_of_a_document_move_as_one_row(spark):
    rows = Terms(spark, SMALL).docs
    asked = spark.createDataFrame([(1, "the", "x"), (1, "the", "y"), (1, "of the", "x"), (2, "", "x"), (3, "no such", "x")], "doc_id long, key string, kind string")
    got = ner.surface_spans(rows, asked)
    words = {r.doc_id: r.k for r in rows.select("doc_id", F.col("tokens.key").alias("k")).collect()}
    want = sorted((1, "of the" if n == 2 else "the", kind, i, i + n) for n, kinds in ((1, "xy"), (2, "x")) for kind in kinds for i in range(len(words[1])) if " ".join(words[1][i : i + n]) == ("the" if n == 1 else "of the"))
    assert sorted((r.doc_id, r.key, r.kind, r.start, r.end) for r in got.collect()) == want
    assert plan(got).count("hashpartitioning") <= 2


def test_an_island_is_not_copied_for_each_span(spark):
    df = spark.createDataFrame([(1, i, i + 2) for i in range(400)], "doc_id long, start int, end int")
    out = ner.accept(df, [F.col("start")])
    text = plan(out)
    assert [line for line in text.splitlines() if "Generate posexplode" in line] == []
    assert sorted(r.start for r in out.where("kept").collect()) == list(range(0, 400, 2))
