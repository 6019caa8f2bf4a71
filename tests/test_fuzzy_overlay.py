"""Fuzzy suggestions, alias overlay and synonym copies against plain Python."""

import difflib
import random

from pyspark.sql import functions as F
from quillspan.operators.fuzzy import alias_evidence, fuzzy_pairs
from quillspan.operators.overlay import overlay_aliases, synonym_copies


def first_near(key, terms):
    if len(key) < 8 or " " not in key or key in terms:
        return None
    for t in terms:
        if len(t) >= 8 and len(t.split(" ")) == len(key.split(" ")) and (t[0], t[-1]) == (key[0], key[-1]) and abs(len(t) - len(key)) <= max(2, int(len(t) * 0.2)):
            if (ratio := difflib.SequenceMatcher(None, key, t).ratio()) >= 0.92:
                return key, t, round(ratio, 5)
    return None


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    terms = sorted({" ".join("".join(rng.choice("abé") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 3))) for _ in range(60)})
    rng.shuffle(terms)
    keys = ["", "abc", None, *terms[:5]]
    for t in terms:
        for _ in range(12):
            x = list(t)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(1, len(x))
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
            keys.append("".join(x))
    surfaces = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] * 2, "key string, doc_id int")
    pairs = fuzzy_pairs(surfaces, spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "key string, ord int"))
    want = {x for k in keys if k and (x := first_near(k, terms))}
    got = [(r.key, r.term, r.ratio) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    evidence = alias_evidence(surfaces, pairs).collect()
    assert len(evidence) == len(want) and all(r.occurrences == 2 * r.df and r.samples == [i for i, k in enumerate(keys) if k == r.key][:3] for r in evidence)
    assert fuzzy_pairs(surfaces.limit(0), surfaces.select("key", F.col("doc_id").alias("ord"))).count() == 0


def test_overlay(spark):
    terms = spark.createDataFrame([("flu", "C1", "J10", "Influenza", 1), ("grippe", "C2", "J10", "Grippe", 2), ("x", None, "", None, 3)], "key string, concept_id string, code string, canonical_term string, ord int")
    aliases = spark.createDataFrame(
        [("Flu", "C1", None, None, 1), ("La Flu", "c9", " j10 ", None, 2), ("la flu", "C2", None, "Other", 3), ("none", "C8", None, None, 4), ("", "C1", None, None, 5), (None, "C1", None, None, 6), ("own", "c2", "J10", " Own ", 7), ("e", "", "", "", 8)],
        "surface_form string, concept_id string, concept_code string, canonical_term string, ord int",
    )
    got = {tuple(r) for r in overlay_aliases(terms, aliases, F.lower("surface_form")).where("source = 'approved_alias'").collect()}
    assert got == {("la flu", "C1", "J10", "Influenza", "approved_alias"), ("own", "C2", "J10", "Own", "approved_alias")}
    assert overlay_aliases(terms, aliases.limit(0), F.lower("surface_form")).count() == 3


def test_synonym_copies(spark):
    text, spans = "sốt và ho và mệt", [(0, 3, "S", "sốt"), (7, 9, "S", "ho"), (13, 16, "S", "mệt"), (4, 6, "O", "và")]
    records = spark.createDataFrame([(1, text, spans), (2, None, None), (3, "ho", [(0, 2, "S", "ho")])], "id int, text string, entities array<struct<start:int,end:int,label:string,text:string>>")
    synonyms = spark.createDataFrame([("sốt", "sốt"), ("ho", " ho khan "), ("mệt", "mỏi"), ("và", "với"), ("x", None)], "text string, replacement string")
    got = {r.id: r for r in synonym_copies(records, synonyms, ["S"], 2).collect()}
    assert set(got) == {"1:aug:1", "1:aug:2", "3:aug:0"}
    one = got["1:aug:1"]
    assert one.text == "sốt và ho khan và mệt" and all(one.text[e.start : e.end] == e.text for e in one.entities)
    assert got["3:aug:0"].text == "ho khan" and {r.id for r in synonym_copies(records, synonyms, ["S"]).collect()} == {"1:aug:1", "3:aug:0"}
