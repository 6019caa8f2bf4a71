"""Written terms by their shapes: against plain search, with words right beside the punctuation."""

import re
from random import Random

from quillspan.operators import ner


def search(texts, terms):
    out = []
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for term in terms:
            if re.search(r"\w", term):
                out += [(i, k, k + len(term), term) for k in range(len(low)) if low.startswith(term, k) and not re.match(r"\w", low[k + len(term) : k + len(term) + 1]) and not (k and re.match(r"\w", low[k - 1]))]
    return sorted(out)


def found(spark, texts, terms):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return ner.bounded_terms(docs, spark.createDataFrame([(t,) for t in terms], "term string"))


def test_any_punctuation_beside_words(spark, monkeypatch):
    rng = Random(9)
    make = lambda n: "".join(rng.choice("abÀ_ ,.(") for _ in range(n))
    texts, terms = [make(rng.randint(0, 60)) for _ in range(60)] + [None, ""], sorted({make(rng.randint(1, 6)).lower() for _ in range(300)})
    want = search(texts, terms)
    rows = lambda df: sorted((r.doc_id, r.start, r.end, r.term) for r in df.collect())
    assert rows(found(spark, texts, terms)) == want and len(want) > 100
    monkeypatch.setattr(ner, "SHAPES", 3)
    assert rows(found(spark, texts, terms)) == want


def test_a_common_first_word_makes_no_pairs(spark):
    """Each term begins with the word of every token; only whole spellings are joined."""
    df = found(spark, ["the x1. " + "the " * 3000], [f"the x{i}." for i in range(3000)])
    assert df.count() == 1
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_near" not in text and "Window" not in text and "spelled" in text
