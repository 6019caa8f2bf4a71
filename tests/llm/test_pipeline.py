"""The corpus pipeline stage by stage against plain Python."""

import random

import corpus_pipeline as cp
import pytest
from test_dedup import brute_classes, brute_lines
from test_models import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    first = spark.createDataFrame(cp.quality_stage(spark, docs, SF).collect(), docs.schema)
    first_rows = {r.doc_id: r.text for r in first.collect()}
    for r in docs.collect():
        n, _, _, _, repeats, _ = brute(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert r.doc_id not in first_rows
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    kept = [r.doc_id in first_rows for r in docs.collect() if r.doc_id in good and brute(r.text)[0] >= 20 and 100 * brute(r.text)[4] <= 30 * brute(r.text)[0]]
    assert sum(kept) >= 0.97 * len(kept)
    second = spark.createDataFrame(cp.language_stage(spark, first, SF).collect(), docs.schema)
    assert second.count() >= 0.98 * len(first_rows)
    third = spark.createDataFrame(cp.line_stage(spark, second, SF).collect(), docs.schema)
    want = brute_lines([(r.doc_id, r.text) for r in second.collect()])
    assert sorted((r.doc_id, r.text) for r in third.collect()) == sorted((i, t) for i, _, _, t in want)
    assert all(r.n_chars == len(r.text) for r in third.collect())
    fourth = cp.near_duplicate_stage(spark, third, SF)
    rows = [(r.doc_id, r.text) for r in third.collect()]
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(i for i, c, _ in brute_classes(rows) if i == c)
    assert fourth.columns == docs.columns


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 50 and {"doc_id", "bucket", "batch"} <= set(out.columns)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_bitmap string, score int, kept int, bucket int"
WORDS = "the cat sat here while many other people were walking along an old river that runs through our town".split()
LINE = "This line stands in every one of the documents and is long enough"


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with clashing further columns."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, 0, 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture
def labels(spark, tmp_path):
    """A folder with labels for the documents 0 to 39, all of them good."""
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def ids(df):
    assert df.columns == list(cp.COLUMNS)
    return sorted((r.doc_id for r in df.collect()), key=str)


def odd(spark):
    rng = random.Random(15)
    good = [(i, prose(rng), "en") for i in range(40)]
    long = " ".join(prose(rng, 1000) for _ in range(60))
    return good, [(None, good[0][1], "en"), (50, None, "en"), (51, "", "en"), (52, "a b", None), (52, "a b", None), (53, long, None), (5, good[5][1], "en")]


def test_quality_odd_rows(spark, labels):
    good, more = odd(spark)
    got = ids(cp.quality_stage(spark, frame(spark, good + more), labels))
    assert got == sorted([*range(40), None, 53, 5], key=str)
    assert ids(cp.quality_stage(spark, frame(spark, []), labels)) == []


def test_language_odd_rows(spark, labels):
    rng = random.Random(16)
    good, more = odd(spark)
    strange = ["".join(rng.choice("bcdfgjkmpqvxz ") for _ in range(400)), "это другой язык и другое письмо " * 9, "漢字文章今日天気" * 30, "123 456 !"]
    rows = good + more + [(60 + i, t, None) for i, t in enumerate(strange)]
    got = ids(cp.language_stage(spark, frame(spark, rows), labels))
    assert not {50, 51, 60, 61, 62, 63} & set(got)
    assert {*range(40), 53} <= set(got) and None in got and got.count(5) == 2
    assert ids(cp.language_stage(spark, frame(spark, [(1, "the cat", None)]), labels)) == []
    assert ids(cp.language_stage(spark, frame(spark, []), labels)) == []


def test_line_odd_rows(spark, labels):
    rows = [(i, f"{LINE}\nown {i}", "en") for i in range(6)] + [(None, LINE, "en"), (7, None, "en"), (8, "", "en"), (9, LINE + "\n" + "x\n" * 20000, "en"), (3, f"{LINE}\nown 3", "en")]
    got = cp.line_stage(spark, frame(spark, rows), labels)
    want = [(i, f"own {i}") for i in range(6)] + [(None, LINE), (7, None), (8, ""), (9, rows[9][1]), (3, "own 3")]
    assert got.columns == list(cp.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert ids(cp.line_stage(spark, frame(spark, []), labels)) == []


def test_near_duplicate_odd_rows(spark, labels):
    rng = random.Random(17)
    a, b = prose(rng, 200), prose(rng, 200)
    near = a + " and more"
    long = " ".join(prose(rng, 1000) for _ in range(40))
    rows = [(1, a, "en"), (1, a, "en"), (1, near, "en"), (1, b, "en"), (2, near, "en"), (3, b + " end", "en"), (4, None, "en"), (4, None, "en"), (5, "", "en"), (None, a, "en"), (6, long, "en"), (7, long + " x", "en"), (8, "two words", "en"), (9, "two words", "en")]
    got = cp.near_duplicate_stage(spark, frame(spark, rows), labels)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    heads = [x for x in kept if x[0] == 1]
    assert len(heads) == 2 and (1, b) in heads and ((1, a) in heads or (1, near) in heads)
    assert ids(got) == sorted([1, 1, 4, 4, 5, None, 6, 8], key=str)
    assert ids(cp.near_duplicate_stage(spark, frame(spark, []), labels)) == []


def test_packing_odd_rows(spark, labels):
    rows = [(1, None, "en"), (1, "", "en"), (None, "a b", "en"), (2, "w " * 70000, "en"), (2, "w " * 70000, "en")]
    got = cp.packing_stage(spark, frame(spark, rows), labels).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 0), ("1", 0), ("2", 70000), ("2", 70000), ("None", 2)]
    assert len({(r.bucket, r.batch, r.batch_slot) for r in got}) == 5
    assert cp.packing_stage(spark, frame(spark, []), labels).count() == 0
