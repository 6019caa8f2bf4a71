"""Span algebra, matching and evaluation on small examples with known answers."""

import unicodedata
from itertools import permutations
from random import Random

from pyspark.sql import functions as F
from quillspan.functions.text import heading_key_of, match_key_of, move_tones, normalize_match_text, similarity, slug_of, strip_marks_of
from quillspan.operators import matching, spans
from quillspan.operators.sections import ONTOLOGY, classify_sections


def span(s, e, label="SYMPTOM", rank=0):
    return {"start": s, "end": e, "label": label, "rank": rank}


def kept(rows):
    return [(r["start"], r["end"]) for r in rows if r["status"] == "KEPT"]


def test_overlap_orders():
    a = [span(0, 7), span(0, 12), span(0, 12), span(14, 16, rank=1), span(15, 20, rank=0)]
    assert kept(spans.resolve_list(a, "longest")) == [(0, 12), (15, 20)]
    assert kept(spans.resolve_list(a, "shortest")) == [(0, 7), (14, 16)]
    assert kept(spans.resolve_list(a, "leftmost")) == [(0, 12), (14, 16)]
    assert kept(spans.resolve_list(a, "source_first"))[-1] == (15, 20)
    status = {(r["start"], r["end"], r["status"]) for r in spans.resolve_list(a, "longest")}
    assert (0, 12, "DUPLICATE") in status and (0, 7, "OVERLAP_DROPPED") in status


def test_resolution_never_overlaps():
    rng = Random(8)
    for order in spans.ORDERS:
        for _ in range(50):
            rows = [span(s := rng.randint(0, 30), s + rng.randint(1, 8), rng.choice("AB"), rng.randint(0, 2)) for _ in range(12)]
            got = sorted(kept(spans.resolve_list(rows, order)))
            assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_tokens_keep_marks_together():
    text = unicodedata.normalize("NFD", "Khoa Y học Hà Nội")
    assert [t["word"] for t in spans.tokens_of(text)] == [unicodedata.normalize("NFD", w) for w in "Khoa Y học Hà Nội".split()]
    assert [text[t["start"] : t["end"]] for t in spans.tokens_of(text)] == [t["word"] for t in spans.tokens_of(text)]


def test_sentences():
    text = "One. Two!\n\nThree 3.5 x"
    assert [text[s["start"] : s["end"]] for s in spans.sentences_of(text)] == ["One.", "Two!", "Three 3.5 x"]


def test_bio_round_trip(spark):
    text = "Bệnh nhân sốt, đau ngực; chụp X-quang."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tokens = docs.select("doc_id", F.posexplode(spans.offset_tokens(F.col("text"))).alias("pos", "t")).select("doc_id", "pos", "t.*")
    gold = spark.createDataFrame([(1, 10, 13, "SYMPTOM"), (1, 15, 23, "SYMPTOM"), (1, 25, 37, "TEST"), (1, 11, 13, "BAD")], "doc_id long, s int, e int, label string")
    issues = spans.boundary_issues(tokens, gold)
    assert [r.label for r in issues.collect()] == ["BAD"]
    good = gold.where("label <> 'BAD'")
    tags = spans.bio_encode(tokens, good)
    assert [r.tag for r in tags.orderBy("pos").collect()][2:9] == ["B-SYMPTOM", "O", "B-SYMPTOM", "I-SYMPTOM", "O", "B-TEST", "I-TEST"]
    back = spans.bio_decode(tags.join(tokens.select("pos", F.col("word")), "pos"))
    assert sorted((r.s, r.e, r.label) for r in back.collect()) == [(2, 3, "SYMPTOM"), (4, 6, "SYMPTOM"), (7, 9, "TEST")]


def test_adjacent_begins_are_two_spans(spark):
    tags = spark.createDataFrame([(1, 0, "B-x"), (1, 1, "B-x"), (1, 2, "O"), (1, 3, "I-y")], "doc_id long, pos int, tag string")
    assert sorted((r.s, r.e, r.label) for r in spans.bio_decode(tags).collect()) == [(0, 1, "x"), (1, 2, "x"), (3, 4, "y")]


def test_html(spark):
    df = spark.createDataFrame([("<b>Tăng huyết áp</b> & x", [(3, 16, "DISEASE")])], "t string, s array<struct<start:int,end:int,label:string>>")
    got = df.select(spans.entity_html(F.col("t"), F.col("s")).alias("h")).first().h
    assert got == '&lt;b&gt;<mark data-label="DISEASE">Tăng huyết áp</mark>&lt;/b&gt; &amp; x'


def test_error_kinds():
    gold = [span(0, 8), span(20, 23, "DISEASE"), span(30, 33)]
    pred = [span(0, 3), span(20, 23), span(40, 42)]
    for typing in (matching.errors_reusing_gold, matching.errors_consuming, matching.errors_global):
        assert sorted(e["type"] for e in typing(pred, gold)) == ["BOUNDARY_ERROR", "FN", "FP", "LABEL_ERROR"]
        assert typing(gold, gold) == []


def test_matching_is_largest():
    rng = Random(9)
    for _ in range(60):
        p = [span(s := rng.randint(0, 12), s + rng.randint(1, 6), "A") for _ in range(4)]
        g = [span(s := rng.randint(0, 12), s + rng.randint(1, 6), "A") for _ in range(4)]
        ok = {(i, j) for _, i, j in matching.edges(p, g, True)}
        best = max(sum((i, j) in ok for i, j in enumerate(o)) for o in permutations(range(4)))
        got = matching.bipartite(p, g)
        assert len(got) == best and all((i, j) in ok for i, j, _ in got)
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)
    assert len(matching.greedy([span(0, 3)] * 2, [span(0, 3)])) == 1
    assert matching.token_overlap([span(1, 2, "D")], [span(0, 2, "D")]) == [(0, 0, 1.0)]


def test_self_evaluation_is_one(spark):
    df = spark.createDataFrame([(1, 0, 3, "A"), (1, 0, 3, "A"), (1, 5, 6, "B")], "doc_id long, s int, e int, label string")
    rows = matching.with_averages(matching.metrics(matching.exact_counts(df, df, ["doc_id", "s", "e", "label"]))).collect()
    assert {r.label for r in rows} == {"A", "B", "MICRO", "MACRO"} and all(r.f1 == 1.0 and r.fp == r.fn == 0 for r in rows)


def test_text_keys(spark):
    assert match_key_of("Đau  Bụng-dưới_x") == "đau bụng dưới x" and strip_marks_of("Đau bụng") == "dau bung"
    assert heading_key_of("II. Đối tượng và phương pháp") == "doi tuong va phuong phap" and slug_of("Tâm Anh!") == "tam-anh"
    df = spark.createDataFrame([("Hòa THỦY khỏe", "a"), (None, "b")], "t string, u string")
    got = df.select(move_tones(F.col("t")).alias("m"), normalize_match_text(F.col("t")).alias("k"), similarity(F.col("t"), F.col("t")).alias("s")).collect()
    assert got[0].m == "Hoà THUỶ khoẻ" and got[0].s == 1.0 and got[1].k is None


def test_sections(spark):
    df = spark.createDataFrame([("ĐẶT VẤN ĐỀ",), ("Tiêu chuẩn lựa chọn",), ("2. Methods",), ("foo bar",), ("",)], "h string")
    got = {r.h: (r.canonical_type, r.confidence) for r in classify_sections(df, "h").collect()}
    assert got == {"ĐẶT VẤN ĐỀ": ("INTRODUCTION", 0.99), "Tiêu chuẩn lựa chọn": ("INCLUSION_CRITERIA", 0.91), "2. Methods": ("METHODS", 0.99), "foo bar": ("OTHER", 0.35), "": ("UNKNOWN", 0.0)}


def test_section_types_are_complete(spark):
    assert len(ONTOLOGY) == 34 and len({k for k, _, _ in ONTOLOGY}) == 34
    df = spark.createDataFrame([("Thời gian nghiên cứu", "METHODS"), ("Acknowledgments", ""), ("3. Data availability", ""), ("LỜI CẢM ƠN", "")], "h string, p string")
    got = {r.h: (r.canonical_type, r.confidence) for r in classify_sections(df, "h", "p").collect()}
    assert got == {"Thời gian nghiên cứu": ("STUDY_TIME", 0.99), "Acknowledgments": ("ACKNOWLEDGEMENT", 0.99), "3. Data availability": ("DATA_AVAILABILITY", 0.99), "LỜI CẢM ƠN": ("ACKNOWLEDGEMENT", 0.99)}
