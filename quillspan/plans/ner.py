"""Dictionary recognition on the documents: phrases of one to three words serve as terms, in token positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import runs_of
from ..operators import ner
from ..operators.relational import cut
from ..registry import query
from .annotation import BASE, MARKED
from .views import Views, term_label

_T = f"translate(%s, '{MARKED}', '{BASE}')"
#: Runs of one to three tokens, and those of them that serve as terms.
_GRAMS = """SELECT doc_id, pos, n, key FROM (SELECT doc_id, pos, unnest([1, 2, 3]) AS n, unnest([token, token || ' ' || b, token || ' ' || b || ' ' || c]) AS key
FROM (SELECT doc_id, pos, token, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) WHERE key IS NOT NULL"""
_PHRASES = "SELECT key, n, ['DISEASE', 'SYMPTOM', 'TREATMENT'][length(key) % 3 + 1] AS label FROM (SELECT key, n, count(DISTINCT doc_id) AS df FROM grams GROUP BY ALL) WHERE (n = 1 AND df >= 5 AND length(key) >= 7) OR (n > 1 AND df >= 8)"
_PLAIN = f"SELECT plain, arg_min(key, (-length(key), key)) AS key, any_value(label) AS label FROM (SELECT *, {_T % 'key'} AS plain FROM phrases) GROUP BY plain HAVING count(DISTINCT label) = 1 AND bool_or(plain <> key) AND NOT bool_or(n = 1)"
_FOUND = f"""SELECT doc_id, pos AS s, pos + g.n AS e, g.n, key, label, 'exact' AS method FROM grams g JOIN phrases p USING (key)
UNION ALL SELECT doc_id, pos, pos + g.n, g.n, a.key, a.label, 'accentless' FROM grams g JOIN plain_terms a ON a.plain = g.key WHERE {_T % 'g.key'} = g.key AND g.key NOT IN (SELECT key FROM phrases)"""
_WITH = f"WITH grams AS ({_GRAMS}), phrases AS ({_PHRASES}), plain_terms AS ({_PLAIN}), found AS ({_FOUND}) "


class Terms:
    """Token arrays of the documents and the terms found in them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.v = Views(spark, sf_dir)
        self._phrases: DataFrame | None = None

    @property
    def docs(self) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
        token = lambda w, i: F.struct(w.alias("key"), F.translate(w, MARKED, BASE).alias("plain"), i.alias("start"), (i + 1).alias("end"), F.lit("").alias("tail"))
        return self.v.table("documents").select("doc_id", "text", F.transform(words, token).alias("tokens"))

    @property
    def phrases(self) -> DataFrame:
        """key, n and label: frequent runs of tokens. Repeats within a document go before the shuffle, and the
        runs are counted once however often they are asked for."""
        if self._phrases is not None:
            return self._phrases
        keys = F.transform("tokens", lambda t: t["key"])
        runs = []
        for n in (1, 2, 3):
            runs.append(self.docs.select(F.lit(n).alias("n"), F.explode(runs_of(keys, n)).alias("key")))
        counted = runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("key", "n").agg(F.count(F.lit(1)).alias("df"))
        frequent = counted.where("(n = 1 AND df >= 5 AND length(key) >= 7) OR (n > 1 AND df >= 8)")
        self._phrases = cut(frequent.select("key", "n", term_label(F.col("key")).alias("label")))
        return self._phrases

    @property
    def index(self) -> DataFrame:
        return self.phrases.select("key", F.col("key").alias("concept_id"), F.lit("").alias("code"), F.col("label").alias("category"), F.lit("canonical").alias("alias_type"), F.lit("").alias("match_term"), F.lit(False).alias("case_sensitive"))

    @property
    def plain(self) -> DataFrame:
        rows = self.phrases.withColumn("plain", F.translate("key", MARKED, BASE))
        grouped = rows.groupBy("plain").agg(F.count_distinct("label").alias("k"), F.bool_or(F.col("plain") != F.col("key")).alias("m"), F.bool_or(F.col("n") == 1).alias("o"), F.min_by("key", F.struct(-F.length("key"), "key")).alias("key"))
        return grouped.where("k = 1 AND m AND NOT o").select("plain", "key")

    @property
    def found(self) -> DataFrame:
        return ner.candidates(self.docs, self.index, self.plain)

    @property
    def model(self) -> DataFrame:
        """A model's terms: in every fourth document the shorter phrases, and one that the text does not have."""
        mine = self.found.where("doc_id % 4 = 0 AND n < 3 AND method = 'exact'").select("doc_id", F.when(F.length("key") % 2 == 0, "DISEASE").otherwise("OTHER").alias("category"), F.substring_index("key", " ", 1).alias("key"))
        invented = self.v.table("documents").where("doc_id % 4 = 0").select("doc_id", F.lit("DISEASE").alias("category"), F.lit("qqqq zzzz").alias("key"))
        return mine.unionByName(invented).distinct()


_MODEL = "SELECT DISTINCT doc_id, CASE WHEN length(key) % 2 = 0 THEN 'DISEASE' ELSE 'OTHER' END AS category, split_part(key, ' ', 1) AS key FROM found WHERE doc_id % 4 = 0 AND n < 3 AND method = 'exact' UNION SELECT doc_id, 'DISEASE', 'qqqq zzzz' FROM documents WHERE doc_id % 4 = 0"


@query(_WITH + "SELECT doc_id, s, e, n, key, label, method, CASE method WHEN 'exact' THEN 1.0 ELSE 0.94 END::DOUBLE AS confidence FROM found")
def nr01_phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of up to three words, and those that match without marks where the text has none."""
    return Terms(spark, sf_dir).found.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "n", "key", F.col("category").alias("label"), "method", "confidence")


@query()
def nr11_document_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, concepts and counts by method of each document; flat selection is tested by brute force."""
    t = Terms(spark, sf_dir)
    result = ner.document_result(t.docs.select("doc_id", "text"), ner.entities(t.found))
    return result.select("doc_id", F.size("entities").alias("n_entities"), F.size("concepts").alias("n_concepts"), "counts", F.transform("entities", lambda x: F.struct(x["start"], x["end"], x["label"])).alias("spans"))


@query()
def nr03_label_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Terms(spark, sf_dir).found.select("doc_id", "start", "end", F.col("category").alias("label"))
    return ner.label_selection(found, {"DISEASE": 0, "SYMPTOM": 1, "TREATMENT": 2})


_MANY = "SELECT key FROM grams WHERE n = 2 GROUP BY key HAVING count(DISTINCT doc_id) BETWEEN 3 AND 7 UNION SELECT key FROM grams WHERE n = 3 GROUP BY key HAVING count(DISTINCT doc_id) BETWEEN 3 AND 7"


@query(_WITH + f""", many AS ({_MANY}) SELECT doc_id, pos AS s, pos + n AS e, key, 0.25::DOUBLE AS confidence FROM grams JOIN many USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1""")
def nr08_ambiguous_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or three tokens that 3 to 7 documents hold stand for phrases of several concepts."""
    t = Terms(spark, sf_dir)
    return ner.ambiguous_phrases(t.docs, _many(t)).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "key", "confidence")


def _many(t: Terms) -> DataFrame:
    keys = F.transform("tokens", lambda x: x["key"])
    runs = None
    for n in (2, 3):
        one = t.docs.select(F.explode(runs_of(keys, n)).alias("key"))
        runs = one if runs is None else runs.unionByName(one)
    return cut(runs.groupBy("key").count().where("count BETWEEN 3 AND 7").select("key"))


@query(_WITH + f""", many AS ({_MANY}), hits AS (SELECT doc_id, pos AS s, pos + n AS e, key FROM grams JOIN many USING (key) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC) = 1)
SELECT doc_id, s, e, key FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, e, key) <= 100""")
def tk03_shown_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Terms(spark, sf_dir)
    found = ner.ambiguous_phrases(t.docs, _many(t)).withColumn("method", F.lit("ambiguous"))
    return ner.shown_suggestions(found).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "key")


@query(_WITH + f""", model AS ({_MODEL}) SELECT m.doc_id, m.category, m.key, g.pos AS s, g.pos + g.n AS e FROM model m JOIN grams g ON g.doc_id = m.doc_id AND g.key = m.key""")
def nr14_surface_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Terms(spark, sf_dir)
    return ner.surface_spans(t.docs, t.model).select("doc_id", "category", "key", F.col("start").alias("s"), F.col("end").alias("e"))


@query(_WITH + f""", model AS ({_MODEL}), hits AS (SELECT m.doc_id, m.key, g.pos AS s, g.pos + g.n AS e FROM model m JOIN grams g ON g.doc_id = m.doc_id AND g.key = m.key)
SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = h.doc_id AND f.n = 3 AND f.s <= h.s AND h.e <= f.e)""")
def jn08_not_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans strictly inside no phrase of three words."""
    t = Terms(spark, sf_dir)
    spans = ner.surface_spans(t.docs, t.model).select("doc_id", "key", "start", "end")
    return ner.not_inside(spans, t.found.where("n = 3")).select("doc_id", "key", F.col("start").alias("s"), F.col("end").alias("e"))


@query(_WITH + f""", model AS ({_MODEL}), ents AS (SELECT * FROM found WHERE n >= 2),
ours AS (SELECT doc_id, CASE label WHEN 'SYMPTOM' THEN 'FINDING' ELSE 'DISEASE' END AS category, key, 'ai+dictionary' AS source, s, e FROM ents),
theirs AS (SELECT DISTINCT doc_id, category, key FROM model m WHERE category IN ('DISEASE', 'FINDING') AND NOT EXISTS (SELECT 1 FROM ents x WHERE x.doc_id = m.doc_id AND x.key = m.key)),
alone AS (SELECT t.doc_id, t.category, t.key, 'ai' AS source, g.pos AS s, g.pos + g.n AS e FROM theirs t JOIN grams g ON g.doc_id = t.doc_id AND g.key = t.key
  WHERE NOT EXISTS (SELECT 1 FROM ents x WHERE x.doc_id = t.doc_id AND x.s <= g.pos AND g.pos + g.n <= x.e AND x.e - x.s > g.n))
SELECT doc_id, category, key, source, list_sort(list(DISTINCT {{'start': s, 'end': e}})) AS spans FROM (SELECT * FROM ours UNION ALL SELECT * FROM alone) GROUP BY doc_id, category, key, source""")
def nr15_merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's phrases of two words or more and a model's terms; invented terms and fragments go."""
    t = Terms(spark, sf_dir)
    return ner.merged_labels(t.docs, t.model, t.found.where("n >= 2"), {"SYMPTOM": "FINDING"}, ("DISEASE", "FINDING")).drop("code")


@query(_WITH + ", lex AS (SELECT key, label FROM phrases WHERE n > 1) SELECT doc_id, pos AS s, pos + g.n AS e, label FROM grams g JOIN lex USING (key)")
def jn11_gold_lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of several tokens, looked up by their first token."""
    t = Terms(spark, sf_dir)
    lexicon = t.phrases.where("n > 1").select("key", "label")
    return ner.phrase_hits(t.docs, lexicon.select("key")).join(lexicon, "key").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "label")


_WRITTEN = "SELECT DISTINCT part || ',' AS term FROM (SELECT regexp_extract(lower(text), '[a-z]{6,} [a-z]{3,},') AS part FROM documents) WHERE part <> '' UNION SELECT DISTINCT regexp_extract(lower(text), '[a-z]{3,}[.] [a-z]{3,}') FROM documents WHERE regexp_matches(lower(text), '[a-z]{3,}[.] [a-z]{3,}')"


def _written(v: Views) -> DataFrame:
    """Terms as they are written: the first two words with a comma, and across the first full stop."""
    docs = v.table("documents").select(F.lower("text").alias("t"))
    both = F.array(F.regexp_extract("t", r"[a-z]{6,} [a-z]{3,},", 0), F.regexp_extract("t", r"[a-z]{3,}[.] [a-z]{3,}", 0))
    return docs.select(F.explode(both).alias("term")).where("term <> ''").distinct()


@query()
def nr12_longest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms between word boundaries, the longest first, 40 a document; tested by brute force."""
    v = Views(spark, sf_dir)
    return ner.longest_terms(ner.bounded_terms(v.table("documents").select("doc_id", "text"), _written(v)))


@query()
def nr13_first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ner.first_terms(ner.bounded_terms(v.table("documents").select("doc_id", "text"), _written(v)))


@query(_WITH + """SELECT doc_id, label, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT doc_id, 'ALL', count(*) FROM found GROUP BY doc_id""")
def mx07_dictionary_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary spans as labels, counted by document."""
    found = Terms(spark, sf_dir).found.select("doc_id", F.explode(F.array("category", F.lit("ALL"))).alias("label"))
    return found.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_WITH + """, lex AS (SELECT DISTINCT doc_id, s, e, label FROM found WHERE n = 3), ai AS (SELECT DISTINCT doc_id, s, e, CASE WHEN length(key) % 2 = 0 THEN label ELSE 'CAUSE' END AS label FROM found WHERE n = 2),
o AS (SELECT l.doc_id, l.s, l.e, l.label, bool_or(a.label <> l.label) AS c, count(a.label) AS k FROM lex l LEFT JOIN ai a ON a.doc_id = l.doc_id AND a.s < l.e AND l.s < a.e GROUP BY ALL)
SELECT doc_id, s, e, label, CASE WHEN c THEN 'LABEL_CONFLICT' WHEN k > 0 THEN 'BOUNDARY_VARIANT' ELSE 'GOLD_LEXICON_ONLY' END AS status FROM o WHERE NOT EXISTS (SELECT 1 FROM ai a WHERE (a.doc_id, a.s, a.e, a.label) = (o.doc_id, o.s, o.e, o.label))""")
def nr25_new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the lexicon that the other side lacks, with what overlaps them there."""
    lex, other = _sides(Terms(spark, sf_dir))
    return audit(lex, other, ("LABEL_CONFLICT", "BOUNDARY_VARIANT", "GOLD_LEXICON_ONLY"), label_first=True)


def _sides(t: Terms) -> tuple[DataFrame, DataFrame]:
    found = t.found.select("doc_id", "start", "end", "n", "key", F.col("category").alias("label"))
    lex = found.where("n = 3").select("doc_id", "start", "end", "label").distinct()
    other = found.where("n = 2").select("doc_id", "start", "end", F.when(F.length("key") % 2 == 0, F.col("label")).otherwise("CAUSE").alias("label")).distinct()
    return lex, other


def audit(spans: DataFrame, against: DataFrame, names: tuple[str, str, str], label_first: bool, doc: str = "doc_id") -> DataFrame:
    """doc, s, e, label and status of spans that `against` lacks: names[0] if an overlapping one has another
    label (or, with label_first false, the same label), names[1] if one overlaps at all, else names[2]."""
    from ..operators.spans import overlapping

    missing = spans.join(against, [doc, "start", "end", "label"], "left_anti").withColumnsRenamed({"start": "a_start", "end": "a_end"})
    others = against.select(doc, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("label").alias("_other"))
    test = (F.col("_other") != F.col("label")) if label_first else (F.col("_other") == F.col("label"))
    flags = overlapping(missing, others, doc).groupBy(doc, "a_start", "a_end", "label").agg(F.bool_or(test).alias("_f"))
    status = F.when(F.col("_f"), names[0]).when(F.col("_f").isNotNull(), names[1]).otherwise(names[2])
    return missing.join(flags, [doc, "a_start", "a_end", "label"], "left").select(doc, F.col("a_start").alias("s"), F.col("a_end").alias("e"), "label", status.alias("status"))


@query(_WITH + """, gold3 AS (SELECT DISTINCT doc_id, s, e, label FROM found WHERE n = 3), ai AS (SELECT DISTINCT doc_id, s, e, CASE WHEN length(key) % 2 = 0 THEN label ELSE 'CAUSE' END AS label FROM found WHERE n = 2),
o AS (SELECT a.doc_id, a.s, a.e, a.label, bool_or(g.label = a.label) AS c, count(g.label) AS k FROM ai a LEFT JOIN gold3 g ON a.doc_id = g.doc_id AND a.s < g.e AND g.s < a.e GROUP BY ALL)
SELECT doc_id, s, e, label, CASE WHEN c THEN 'BOUNDARY_CANDIDATE' WHEN k > 0 THEN 'LABEL_CANDIDATE' ELSE 'MISSING_FROM_GOLD_CANDIDATE' END AS status FROM o WHERE NOT EXISTS (SELECT 1 FROM gold3 g WHERE (g.doc_id, g.s, g.e, g.label) = (o.doc_id, o.s, o.e, o.label))""")
def nr26_prediction_union_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted spans that the gold lacks, by what overlaps them there."""
    gold, predicted = _sides(Terms(spark, sf_dir))
    return audit(predicted, gold, ("BOUNDARY_CANDIDATE", "LABEL_CANDIDATE", "MISSING_FROM_GOLD_CANDIDATE"), label_first=False)


@query("""WITH terms AS (SELECT unnest(['DISEASE', 'DISEASE', 'SYMPTOM']) AS type, unnest(['THE ', 'ation', 'und']) AS term)
SELECT doc_id, type, lower(term) AS name, strpos(lower(text), lower(term)) - 1 AS s FROM documents, terms WHERE contains(lower(text), lower(term))""")
def nr29_fixed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each of a few fixed terms: a literal list, not a table."""
    docs = Views(spark, sf_dir).table("documents").select("doc_id", F.lower("text").alias("t"))
    terms = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(t.lower()).alias("name")) for k, t in (("DISEASE", "THE "), ("DISEASE", "ation"), ("SYMPTOM", "und"))])
    each = docs.select("doc_id", "t", F.explode(terms).alias("x")).select("doc_id", "x.type", "x.name", F.instr("t", F.col("x.name")).alias("at"))
    return each.where("at > 0").select("doc_id", "type", "name", (F.col("at") - 1).cast("long").alias("s"))


@query(_WITH + """SELECT doc_id, configuration, count(*) AS spans, count(DISTINCT key) AS terms FROM (
  SELECT doc_id, key, 'AI' AS configuration FROM found WHERE n = 2 UNION ALL SELECT doc_id, key, 'LEXICON' FROM found WHERE n = 3 UNION ALL SELECT doc_id, key, 'UNION' FROM found WHERE n > 1) GROUP BY ALL""")
def mx09_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by configuration: each source alone and their union."""
    found = Terms(spark, sf_dir).found.where("n > 1")
    names = F.when(F.col("n") == 2, F.array(F.lit("AI"), F.lit("UNION"))).otherwise(F.array(F.lit("LEXICON"), F.lit("UNION")))
    return found.select("doc_id", "key", F.explode(names).alias("configuration")).groupBy("doc_id", "configuration").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("key").alias("terms"))


@query()
def mx08_lexicon_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon spans over the documents, resolved with the source first; flat selection is tested by brute force."""
    lex, other = _sides(Terms(spark, sf_dir))
    both = lex.withColumn("source", F.lit(0)).unionByName(other.withColumn("source", F.lit(1)))
    order = [F.col("source"), F.col("start") - F.col("end"), F.col("start"), F.col("label")]
    return ner.accept(both, order).where("kept").select("doc_id", "start", "end", "label", "source")
