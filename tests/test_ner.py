"""Dictionary recognition against plain loops over random spans, tokens and texts."""

import re
import unicodedata
from random import Random

from pyspark.sql import functions as F
from quillspan.operators import dictionary, matching, ner, relational, spans


def overlap(a, b):
    return a["start"] < b["end"] and b["start"] < a["end"]


def plain_resolve(rows, order):
    """All spans against all kept ones."""
    kept, seen, out = [], set(), []
    for s in sorted(rows, key=spans.ORDERS[order]):
        other = next((k for k in kept if overlap(s, k)), None)
        identity = s["start"], s["end"], s["label"]
        status = "DUPLICATE" if identity in seen else "OVERLAP_DROPPED" if other else "KEPT"
        seen.add(identity)
        if status == "KEPT":
            kept.append(s)
        out.append((s["start"], s["end"], s["label"], s["rank"], status, other and other["start"], other and other["end"]))
    return sorted(out, key=str)


def random_spans(rng, n, width=40):
    return [{"start": (s := rng.randint(0, width)), "end": s + rng.randint(1, 9), "label": rng.choice("ABC"), "rank": rng.randint(0, 2)} for _ in range(n)]


def test_every_order_of_resolution():
    rng = Random(1)
    for order in spans.ORDERS:
        for _ in range(80):
            rows = random_spans(rng, rng.randint(0, 25))
            got = [(r["start"], r["end"], r["label"], r["rank"], r["status"], r["kept_start"], r["kept_end"]) for r in spans.resolve_list(rows, order)]
            assert sorted(got, key=str) == plain_resolve(rows, order)


def test_accept_by_islands(spark):
    rng = Random(2)
    docs = {d: random_spans(rng, 30, 120) for d in range(8)}
    rows = [(d, i, s["start"], s["end"], s["label"]) for d, group in docs.items() for i, s in enumerate(group)]
    df = spark.createDataFrame(rows, "doc_id long, i int, start int, end int, label string")
    got = {(r.doc_id, r.i): (r.kept, r.kept_start, r.kept_end) for r in ner.accept(df, [F.col("start") - F.col("end"), F.col("start"), F.col("i")]).collect()}
    for d, group in docs.items():
        kept = []
        for i in sorted(range(len(group)), key=lambda i: (group[i]["start"] - group[i]["end"], group[i]["start"], i)):
            other = next((k for k in kept if overlap(group[i], k)), None)
            assert got[d, i] == (other is None, other and other["start"], other and other["end"])
            if other is None:
                kept.append(group[i])
    assert ner.accept(df.limit(0), [F.col("start")]).count() == 0


def test_label_selection(spark):
    df = spark.createDataFrame([(1, 0, 5, "B"), (1, 0, 5, "B"), (1, 0, 5, "A"), (1, 4, 6, "A"), (1, 7, 9, "B")], "doc_id long, start int, end int, label string")
    got = sorted((r.start, r.end, r.label, r.status) for r in ner.label_selection(df, {"A": 0, "B": 1}).collect())
    assert got == [(0, 5, "A", "KEPT"), (0, 5, "B", "DUPLICATE"), (0, 5, "B", "OVERLAP_DROPPED"), (4, 6, "A", "OVERLAP_DROPPED"), (7, 9, "B", "KEPT")]


def test_overlaps_and_matching_equal_all_pairs():
    rng = Random(3)
    for _ in range(200):
        p, g = random_spans(rng, rng.randint(0, 15)), random_spans(rng, rng.randint(0, 15))
        assert list(matching.near(p, g)) == [(i, j) for i in range(len(p)) for j in range(len(g)) if overlap(p[i], g[j])]
        wanted = sorted(((matching.overlap_ratio(p[i], g[j]), i, j) for i in range(len(p)) for j in range(len(g)) if p[i]["label"] == g[j]["label"]), reverse=True)
        used, pairs = (set(), set()), []
        for score, i, j in wanted:
            if score >= 0.5 and i not in used[0] and j not in used[1]:
                used[0].add(i), used[1].add(j)
                pairs.append((i, j, score))
        assert matching.greedy(p, g) == pairs
        for typing in matching.TYPING.values():
            errors = typing(p, g)
            exact = len(matching.greedy(p, g, False))
            hit_p = [e["pred"] for e in errors if e["pred"] is not None]
            assert len(hit_p) == len(set(hit_p))
            if typing is not matching.errors_reusing_gold:
                hit_g = [e["gold"] for e in errors if e["gold"] is not None]
                assert len(hit_g) == len(set(hit_g)) and len(hit_p) + exact == len(p) and len(hit_g) + exact == len(g)
            assert all(e["type"] in ("FP", "FN") or overlap(p[e["pred"]], g[e["gold"]]) for e in errors)


def terms(spark):
    rows = [("tăng huyết áp", "C1", "canonical", "", False), ("huyết áp", "C2", "canonical", "", False), ("đau lưng yêu thống", "C3", "alias", "Đau lưng (Yêu thống)", False), ("ho", "C4", "abbreviation", "HO", True)]
    return spark.createDataFrame([(k, c, c, "Bệnh Lý", kind, m, s) for k, c, kind, m, s in rows], "key string, concept_id string, code string, category string, alias_type string, match_term string, case_sensitive boolean")


def test_candidates_and_result(spark):
    text = unicodedata.normalize("NFC", "Tăng huyết áp, tang huyet ap; Đau lưng (Yêu thống). ho HO u mô")
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").withColumn("tokens", ner.keyed_tokens(F.col("text")))
    plain = spark.createDataFrame([("tang huyet ap", "tăng huyết áp"), ("huyet ap", "huyết áp")], "plain string, key string")
    found = ner.candidates(docs, terms(spark), plain)
    rows = {(text[r.start : r.end], r.method) for r in found.collect()}
    assert rows == {("Tăng huyết áp", "exact"), ("huyết áp", "exact"), ("tang huyet ap", "accentless"), ("huyet ap", "accentless"), ("Đau lưng (Yêu thống)", "alias"), ("HO", "abbreviation")}
    result = {r.doc_id: r for r in ner.document_result(docs.select("doc_id", "text"), ner.entities(found)).collect()}
    assert [e.text for e in result[1].entities] == ["Tăng huyết áp", "tang huyet ap", "Đau lưng (Yêu thống)", "HO"]
    assert result[1].counts == {"exact": 1, "accentless": 1, "alias": 1, "abbreviation": 1} and len(result[1].concepts) == 3
    assert result[2].entities == [] and result[3].counts == {}


def test_tokens_hold_marks_and_tails():
    text = unicodedata.normalize("NFD", "Khoa học). x")
    got = ner.tokens_of(text)
    assert [t["key"] for t in got] == ["khoa", unicodedata.normalize("NFC", "học"), "x"] and got[1]["tail"] == ")." and got[1]["plain"] == "hoc"
    assert [text[t["start"] : t["end"]] for t in got] == unicodedata.normalize("NFD", "Khoa học x").split()


def test_merged_labels(spark):
    text = "ung thư biểu mô và ho khan"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("tokens", ner.keyed_tokens(F.col("text")))
    chosen = spark.createDataFrame([(1, 0, 15, "ung thư biểu mô", "C80", "Bệnh Lý")], "doc_id long, start int, end int, key string, code string, category string")
    model = spark.createDataFrame([(1, "Bệnh lý", "biểu mô"), (1, "Triệu chứng", "ho khan"), (1, "Bệnh lý", "không có"), (1, "Thuốc", "ung thư biểu mô"), (1, "Khác", "ho")], "doc_id long, category string, key string")
    got = ner.merged_labels(docs, model, chosen, {"Bệnh Lý": "Bệnh lý"}, ("Bệnh lý", "Triệu chứng", "Thuốc")).collect()
    assert sorted((r.category, r.key, r.code, r.source, [(s.start, s.end) for s in r.spans]) for r in got) == [("Bệnh lý", "ung thư biểu mô", "C80", "ai+dictionary", [(0, 15)]), ("Triệu chứng", "ho khan", "", "ai", [(19, 26)])]


def test_bounded_terms_equal_search(spark):
    rng = Random(4)
    words = ["ab", "a", "b", "ab_", "a-b", "(a)", "b.", "ba"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["AB ab", None, ""]
    terms_ = ["ab", "a b", "a-b", "(a) b", "b. a", "ba ba", "(a)", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.term) for r in ner.bounded_terms(docs, spark.createDataFrame([(t,) for t in terms_], "term string")).collect())
    want = []
    for i, t in enumerate(texts):
        for term in terms_[:-1]:
            low = (t or "").lower()
            want += [(i, k, k + len(term), term) for k in range(len(low)) if low.startswith(term, k) and not re.match(r"\w", low[k + len(term) : k + len(term) + 1]) and not (k and re.match(r"\w", low[k - 1]))]
    assert got == sorted(want)
    hits = ner.bounded_terms(docs, spark.createDataFrame([(t,) for t in terms_], "term string"))
    for chosen in (ner.longest_terms(hits, limit=3), ner.first_terms(hits, limit=3)):
        by: dict = {}
        for r in chosen.collect():
            by.setdefault(r.doc_id, []).append((r.start, r.end))
        for found in by.values():
            found.sort()
            assert len(found) <= 3 and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_running_totals_over_many_cells(spark):
    rng = Random(5)
    rows = [(g, i * 3, rng.randint(0, 9)) for g in ("a", "b", None) for i in range(200) if rng.random() > 0.3]
    df = spark.createDataFrame(rows, "g string, o long, n int")
    got = {(r.g, r.o): r.t for r in relational.running_total(df, ["g"], "o", F.col("n"), "t", cell=16).collect()}
    before = {(r.g, r.o): r.p for r in relational.previous_value(df, ["g"], "o", "n", "p", cell=16).collect()}
    for g in ("a", "b", None):
        total, last = 0, None
        for _, o, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += n
            assert got[g, o] == total and before[g, o] == last
            last = n
    carried = {r.o: r.c for r in dictionary.carried(df.where("g = 'a'").withColumn("v", F.when(F.col("n") > 6, F.col("n"))), "o", "v", "c", cell=16).collect()}
    last = None
    for _, o, n in sorted(r for r in rows if r[0] == "a"):
        last = n if n > 6 else last
        assert carried[o] == last
