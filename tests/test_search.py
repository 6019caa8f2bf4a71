"""Passages inside texts, and places of a phrase, against plain search."""

from random import Random

from pyspark.sql import functions as F
from quillspan.functions.text import occurrences, runs_of
from quillspan.operators.search import containing


def test_containing(spark):
    rng = Random(1)
    words = ["ab", "a", "b", "abc", "ß", "b.", "-", "a_b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(98, None), (99, "")]
    passages = []
    for k in range(120):
        source = rng.choice(docs[:60])[1]
        a = rng.randint(0, max(0, len(source) - 1))
        passages.append((k, source[a : a + rng.randint(1, 40)] or "a"))
    passages += [(200, None), (201, ""), (202, text(6)), (203, "zzz"), (204, passages[0][1])]
    got = sorted((r.doc_id, r.item_id) for r in containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string"), "doc_id", "item_id").collect())
    want = sorted((d, k) for d, t in docs for k, p in passages if t is not None and p is not None and p in t)
    assert got == want and len(want) > 150


def test_occurrences_and_runs(spark):
    rng = Random(2)
    rows = [("".join(rng.choice("abß.") for _ in range(rng.randint(0, 25))),) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    for phrase in ("aa", "a", "ab", "a.", "ßß"):
        for r in df.select("t", occurrences(F.col("t"), phrase).alias("o")).collect():
            assert r.o == (None if r.t is None else [i for i in range(len(r.t)) if r.t.startswith(phrase, i)])
    lists = [([rng.choice("abc") for _ in range(rng.randint(0, 6))],) for _ in range(60)]
    for n in (1, 2, 3):
        for r in spark.createDataFrame(lists, "w array<string>").select("w", runs_of(F.col("w"), n).alias("r")).collect():
            assert r.r == list(dict.fromkeys(" ".join(r.w[i : i + n]) for i in range(len(r.w) - n + 1)))
