"""Quality rules and language identification: brute force, held-out accuracy, edge cases."""

import random
import re
import zlib
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillspan.llm import language_id
from quillspan.llm.language_id import CrossParser, SuffixAutomaton, identify, learn, phrases, symbols
from quillspan.llm.quality import IsolationForest, fit, quality_rules, statistics
from quillspan.llm.queries import held_out

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_statistics():
    rng = random.Random(6)
    texts = ["", "a\x85b c d\x1ce", "x y " * 40, "\n\n# a|b\n# a|b\n"] + [" ".join(rng.choice("ab\n#") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    got = statistics([t.encode() for t in texts])
    assert [tuple(got[k][i] for k in got) for i in range(len(texts))] == [brute(t) for t in texts]


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(7)
    good = rng.normal(0, 1, (500, 3))
    good[:, 2] = 0
    bad = good[:50] + np.array([0, 0, 5.0])
    x, y = np.concatenate([good, bad]), np.arange(550) < 500
    forest = IsolationForest.fit(good, 0.1 * (x.max(axis=0) - x.min(axis=0))).calibrate(x, y)
    scores = forest.score(x)
    assert (scores[y] <= forest.threshold).mean() > 0.99 and (scores[~y] > forest.threshold).mean() > 0.9
    assert IsolationForest.fit(np.zeros((0, 3))).calibrate(np.zeros((0, 3)), np.zeros(0, bool)).score(x).shape == (550,)


def test_quality_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules(docs, forest).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    clean = [rows[i] for i, q in truth.items() if q == 1 and not rows[i].base_failed]
    junk = [rows[i] for i, q in truth.items() if q == 0]
    assert np.mean([r.kept for r in clean]) > 0.98 and np.mean([r.kept for r in junk]) < 0.1
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == brute(r.text) for r in list(rows.values())[:150])
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "w " * 50000, 3), (2, "w " * 50000, 3)], "doc_id long, text string, _s int")
    got = quality_rules(odd, forest).collect()
    assert len(got) == 4 and not any(r.kept for r in got) and all(r._s == 3 for r in got)
    assert quality_rules(odd.limit(0), forest).count() == 0
    nobody = fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rules(odd, nobody).count() == 4


def test_automaton_and_lock_step():
    a = SuffixAutomaton(b"abracadabra")
    has = lambda w: phrases(a, w) == 1
    assert all(has(b"abracadabra"[i:j]) for i in range(11) for j in range(i + 1, 12)) and not has(b"aa") and not has(b"abz")
    samples = {"x": [symbols("the cat sat on the mat")], "y": [symbols("le chat est sur la table aaaaaaa")]}
    parser = CrossParser.fit(samples)
    plain = [SuffixAutomaton(b"".join(samples[n])) for n in parser.languages]
    rng = random.Random(8)
    tests = ["the cat", "la table", "zzz", "жук the", "a" * 3000, "aab" * 5000, "q", "."] + ["".join(rng.choice("theca tsl") for _ in range(rng.randint(1, 4000))) for _ in range(30)]
    coded = [symbols(t) for t in tests]
    want = [[phrases(m, s) for m in plain] for s in coded]
    assert parser.counts(coded).tolist() == want  # phrases run over the ends of blocks
    for lanes in (1, 3, 7):
        with mock.patch.object(language_id, "LANES", lanes):
            assert parser.counts(coded).tolist() == want


def test_scripts_and_unknown_languages():
    rng = random.Random(9)
    words = {"en": "the cat sat here while many other people were walking along".split(), "ru": "это совсем простой текст который люди читают каждый день".split(), "zh": ["漢字", "文章", "今日", "天気", "我們", "學習", "語言"], "ja": ["これは", "日本語", "の文章", "です", "天気", "今日は"]}
    some = lambda name, n: ("" if name in ("zh", "ja") else " ").join(rng.choice(words[name]) for _ in range(n))
    parser = CrossParser.fit({k: [symbols(some(k, 400))] for k in words}, {k: [symbols(some(k, 80)) for _ in range(5)] for k in words})
    for name in words:
        assert all((p := parser.predict([some(name, 40)])[0])[0] == name and p[1] > 0.9 for _ in range(20))
    strange = ["".join(rng.choice("bcdfgjkmpqvxz ") for _ in range(300)), "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺ" * 20, "ελληνικά γράμματα " * 9]
    assert all(score < 0.1 for _, score in parser.predict(strange))


def test_language_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    parser = learn(docs, ~held_out())
    got = {r.doc_id: r for r in identify(docs, parser).collect()}
    out = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 150 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97 and np.mean([r.score > 0.9 for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    other = docs.where(held_out()).selectExpr("doc_id", "'zz' AS lang", "text").unionByName(docs.where(~held_out()))
    again = learn(other, ~held_out())  # held-out rows teach nothing
    assert again.languages == parser.languages and (again.table == parser.table).all() and (again.middle == parser.middle).all()
    odd = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (3, "123 ...", "a", 1), (4, "жж", "a", 1), (4, "жж", "a", 1), (5, "the of rend " * 100_000, "a", 1)], "doc_id long, text string, score string, p int")
    rows = identify(odd, parser).collect()
    assert [r.lang_pred for r in rows if r.doc_id < 4] == ["und"] * 3 and len(rows) == 6 and all(r.p == 1 for r in rows)
    assert [(r.lang_pred, r.score > 0.5) for r in rows if r.doc_id == 5] == [("en", True)]
    nothing = learn(docs.limit(0), F.lit(True))
    assert identify(odd, nothing).where("lang_pred <> 'und'").count() == 0 and identify(odd.limit(0), parser).count() == 0


def test_long_labelled_texts_are_taken_whole(spark):
    long = "wort " * 60_000
    one = learn(spark.createDataFrame([(1, long, "de"), (2, None, "de"), (3, "text", None)], "doc_id long, text string, lang string"), F.lit(True))
    assert one.languages == ["de"] and one.predict(["wort wort"])[0][0] == "de"


@pytest.mark.parametrize("name", ["op3_chat_format", "op10_line_dedup"])
def test_oracles(spark, name):
    import oracle
    from quillspan.llm import queries

    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""
