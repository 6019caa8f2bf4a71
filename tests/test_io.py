"""Readers, writers, pages, layout and streams on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from quillspan.functions import html
from quillspan.operators import layout
from quillspan.operators.language_gate import Gate, assess
from quillspan.operators.relational import latest_by, upsert
from quillspan.sources import readers, writers
from quillspan.streaming.streams import event_counts, latest_into, latest_rows, new_fingerprints, rate_limit


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "input_text": "x"}\n\n{"id": "2"}\n', encoding="utf-8")
    assert sorted(r.id for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == ["1", "2"]
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\nbroken{\n{"id": "3"}\n', encoding="utf-8")
    got = {r.id: r.parse_error for r in readers.read_jsonl_tolerant(spark, str(tmp_path / "b.jsonl")).collect()}
    assert got == {"1": False, "__invalid_line_2": True, "3": False}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_conll_and_writers(spark, tmp_path):
    (tmp_path / "x.conll").write_text("bệnh lao\tB-D\n,\tO\n\nho\tB-S\nlone\n", encoding="utf-8")
    rows = readers.read_conll(spark, str(tmp_path / "x.conll")).orderBy("sentence", "pos").collect()
    assert [(r.sentence, r.token, r.tag, r.issue) for r in rows] == [(0, "bệnh lao", "B-D", None), (0, ",", "O", None), (1, "ho", "B-S", None), (1, "lone", None, "MISSING_TAG")]
    tokens = spark.createDataFrame([(1, 0, "ho", "B-S"), (1, 1, ".", "O"), (1, 2, "x", "O")], "doc_id long, pos int, token string, tag string")
    text = writers.bio_lines(tokens).first().text
    assert text == "ho\tB-S\n.\tO\n\nx\tO\n\n"
    index = writers.line_index(spark.createDataFrame([(1, "a\n\n", "p"), (2, "b\nc\n\n", "p")], "id long, text string, part string"), "id").orderBy("id").collect()
    assert [(r.start_line, r.end_line) for r in index] == [(1, 2), (3, 5)]
    record = writers.chat_records(spark.range(1), "sys", F.lit("q"), F.lit("a")).first().record
    assert [t["role"] for t in json.loads(record)["contents"]] == ["user", "model"]
    names = writers.sequence_names(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "slug string, n long"), "slug", F.col("n"), spark.createDataFrame([("a", 4)], "slug string, n long"))
    assert sorted(r.name for r in names.collect()) == ["a_000005", "a_000006", "b_000001"]


def test_brat(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Bệnh nhân bị viêm phổi.", encoding="utf-8")
    (tmp_path / "d.ann").write_text("T1\tD 13 22\tviêm phổi\nT2\tD 0 9\tviêm phổi\nT3\tX 0 4\tBệnh\nT4\tD 0 4;5 9\tBệnh nhân\nT5\tD 0 3\tzzz\n", encoding="utf-8")
    got = readers.read_brat(spark, str(tmp_path), frozenset({"D"})).first()
    assert [(e.start, e.end, e.issue) for e in got.entities] == [(13, 22, None), (13, 22, None), (None, None, "OTHER_TYPE"), (None, None, "DISCONTINUOUS"), (None, None, "TEXT_MISMATCH")]


def test_artifact_and_files(spark, tmp_path):
    body = json.dumps({"version": "v1", "entries": [{"id": "a"}, {"id": "b"}]}).encode()
    (tmp_path / "m.json").write_bytes(body)
    sha = hashlib.sha256(body).hexdigest()
    assert readers.verified_artifact(spark, str(tmp_path / "m.json"), sha, 2, "id: string").count() == 2
    for bad in (("0", 2), (sha, 3)):
        with pytest.raises(ValueError):
            readers.verified_artifact(spark, str(tmp_path / "m.json"), *bad, "id: string")
    (tmp_path / "in" / "quarantine").mkdir(parents=True)
    for name, data in (("a.pdf", b"%PDF-1"), ("b.pdf", b"no"), ("quarantine/c.pdf", b"%PDF")):
        (tmp_path / "in" / name).write_bytes(data)
    checked = readers.pdf_checks(readers.list_documents(spark, str(tmp_path / "in"))).collect()
    assert sorted((r.path[-5:], r.problem) for r in checked) == [("a.pdf", None), ("b.pdf", "NOT_PDF")]


def test_pages():
    page = html.Page('<html lang="vi"><head><title>T</title><meta name="citation_title" content="A"><meta name="citation_author" content="X"><meta name="citation_date" content="2023/01"></head><body><h2>Vol 5 2021</h2><a href="/issue/view/7">No 1</a><a href="/article/view/12">x</a><a href="/article/view/12/9">PDF</a><a href="https://o.org/article/view/3">y</a><a href="?page=2#i">2</a><p>Text <b>bold</b></p><p>Hotline 0912 345 678</p><script>no</script></body></html>', "https://j.org/a/")
    assert html.metadata(page)["title"] == "A" and html.metadata(page)["year"] == 2023 and html.metadata(page)["html_lang"] == "vi"
    assert html.article_links(page) == ["https://j.org/article/view/12"]
    assert html.issue_links(page) == [{"url": "https://j.org/issue/view/7", "year": 2021}]
    assert html.next_links(page) == ["https://j.org/a/?page=2"]
    assert html.question_answer(page) == {"question": "Text bold", "answer": ""} and "no" not in "".join(page.text).split()


def test_layout(spark):
    def line(page, block, text, x0, y0, x1, y1, size=10.0, bold=0.0, n=1):
        return 1, page, block, 0, text, x0, y0, x1, y1, size, bold, 600.0, 800.0, n

    rows = [line(p, f"{p}h", f"Journal {p}", 50.0, 10.0, 200.0, 20.0) for p in (1, 2)] + [line(1, "1n", "12", 300.0, 780.0, 310.0, 790.0)]
    rows += [line(1, "w", "2.1 Study design", 50.0, 100.0, 550.0, 120.0, 13.0, 1.0), line(1, "r", "right column body text.", 320.0, 130.0, 550.0, 140.0), line(1, "l2", "left two is body text.", 50.0, 160.0, 280.0, 170.0), line(1, "l1", "left one is body text.", 50.0, 130.0, 280.0, 140.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, block_id string, line_index int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold_ratio double, page_width double, page_height double, block_line_count int")
    body = layout.without_margins(lines)
    assert {r.block_id for r in body.collect()} == {"w", "r", "l1", "l2"}
    assert [r.block_id for r in layout.reading_order(body).orderBy("order").collect()] == ["w", "l1", "l2", "r"]
    sized = body.join(layout.body_size(body), "doc_id")
    heads = layout.headings(sized)
    assert [r.block_id for r in heads.collect()] == ["w"]
    assert layout.heading_score(heads, F.lit(True)).first().heading_score == 1.0
    tables = spark.createDataFrame([(1, 1, 0.0, 125.0, 300.0, 150.0)], "doc_id long, page int, tx0 double, ty0 double, tx1 double, ty1 double")
    assert "l1" not in {r.block_id for r in layout.without_table_lines(body, tables).collect()}
    tree = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 20, 3), (1, 30, 2), (1, 40, 1)], "doc_id long, position int, level int")
    assert [r.parent_position for r in layout.section_parents(tree).orderBy("position").collect()] == [None, 0, 10, 0, None]
    ends = layout.section_bounds(tree, spark.createDataFrame([(1, 99)], "doc_id long, length int")).orderBy("position").collect()
    assert [r.end for r in ends] == [10, 20, 30, 40, 99]
    flow = spark.createDataFrame([("a hyphen-\nated line\nwraps\n\ninto this.\n\n- item",)], "t string").select(layout.reflow(F.col("t")).alias("r")).first().r
    assert flow == "a hyphenated line wraps into this.\n\n- item"


def test_gate(spark):
    gate = Gate(words=("và", "của", "là", "bệnh", "nhân"), other_words=("the", "of", "and", "is", "with"), chunk_chars=180, min_chars=100)
    vi, en = "Bệnh nhân và điều trị của bệnh là sốt. ", "The patient is with fever and the treatment of it. "
    df = spark.createDataFrame([("vi", vi * 12, 0.9, 0.0), ("en", en * 12, 0.0, 0.9), ("none", "", 0.0, 0.0), ("odd", "1234 @@@ --- " * 20, 0.0, 0.0)], "k string, text string, v double, e double")
    got = {r.k: r.status for r in assess(df, gate, p_target=F.lit(0.9), p_other=F.lit(0.0)).where("k = 'vi'").collect()}
    got |= {r.k: r.status for r in assess(df, gate, p_target=F.lit(0.0), p_other=F.lit(0.9)).where("k = 'en'").collect()}
    got |= {r.k: r.status for r in assess(df, gate).where("k IN ('none', 'odd')").collect()}
    assert got == {"vi": "ACCEPTED", "en": "REJECTED_OTHER", "none": "REJECTED_NO_TEXT", "odd": "REJECTED_MIXED"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, v string")
    assert sorted(((r.k, r.v) for r in upsert(old, new, ["k"], [F.desc("v")]).collect()), key=str) == [(1, "a"), (2, "y"), (3, "z"), (None, "n")]
    assert latest_by(new, ["k"], [F.desc("v")]).count() == 3


def test_streams(spark, tmp_path):
    base = [("u1", f"2024-01-01 00:{m:02d}:00") for m in range(0, 14, 2)] + [("u1", "2024-01-01 02:00:00"), ("u2", "2024-01-01 00:00:00")]
    rows = spark.createDataFrame(base, "who string, s string").select("who", F.to_timestamp("s").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    limited = run(rate_limit(source(), "who", "at"), "append", "limited")
    assert sorted(r.attempts for r in limited if r.who == "u1") == [1, 1, 2, 3, 4, 5, 6, 7] and sum(r.blocked for r in limited) == 2
    assert sum(r.n for r in run(event_counts(source(), "at", "who"), "complete", "counts")) == len(base)
    qa = source().select("at", F.lit("Q").alias("question"), F.col("who").alias("answer"))
    assert len(run(new_fingerprints(qa, "at", "5 hours").select("fingerprint"), "append", "fresh")) == 2
    merge = latest_into(str(tmp_path / "latest"), ["who"], ["at"], buckets=4)
    assert latest_rows(spark, str(tmp_path / "latest")) is None
    merge(rows, 0)
    merge(rows, 0)  # a batch that is run again
    first = {r.who: r.at for r in latest_rows(spark, str(tmp_path / "latest")).collect()}
    assert first == {r.who: r.m for r in rows.groupBy("who").agg(F.max("at").alias("m")).collect()} and len(first) == 2
    one = sorted(first)[0]
    merge(rows.where(F.col("who") == one).limit(1).withColumn("at", F.timestamp_seconds(F.lit(4_000_000_000))).select(rows.columns), 1)
    second = {r.who: r.at for r in latest_rows(spark, str(tmp_path / "latest")).collect()}
    assert len(second) == 2 and second[one] > first[one] and all(second[k] == first[k] for k in first if k != one)
