"""Alignment, verification and review of annotations on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..registry import query
from .views import Views

LABELS = ("DISEASE", "SYMPTOM", "TREATMENT")
#: Entities with offsets of which two thirds are off: the first two long words of each document.
_ENTITIES = """SELECT doc_id, ord, body, text, ['DISEASE', 'SYMPTOM', 'OTHER'][(doc_id % 3 + 1)::INT] AS label, CASE WHEN doc_id % 5 > 0 THEN strpos(body, text) - 1 + doc_id % 4 % 3 END AS s, CASE WHEN doc_id % 5 > 0 THEN strpos(body, text) - 1 + doc_id % 4 % 3 + length(text) END AS e
FROM (SELECT doc_id, text AS body, unnest([1, 2, 3]) AS ord, unnest([regexp_extract(text, '[a-z]{6,}'), regexp_extract(text, '[a-z]{8,}'), regexp_extract(text, '[a-z]{6,}')]) AS text FROM documents)"""


def _entities(v: Views) -> DataFrame:
    words = F.array(*[F.regexp_extract("body", p, 0) for p in ("[a-z]{6,}", "[a-z]{8,}", "[a-z]{6,}")])
    docs = v.table("documents").select("doc_id", F.col("text").alias("body"))
    rows = docs.select("doc_id", "body", F.posexplode(words).alias("i", "text")).withColumn("ord", F.col("i") + 1)
    start = F.when(F.col("doc_id") % 5 > 0, F.instr("body", F.col("text")) - 1 + F.col("doc_id") % 4 % 3)
    label = F.element_at(F.array(F.lit("DISEASE"), F.lit("SYMPTOM"), F.lit("OTHER")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("doc_id", "ord", "body", "text", label.alias("label"), start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"))


_E = f"WITH ents AS ({_ENTITIES}) "


@query(_E + """, v AS (SELECT doc_id, ord, body, text, label, coalesce(s, strpos(body, text) - 1) AS s, coalesce(e, strpos(body, text) - 1 + length(text)) AS e FROM ents WHERE text <> '' AND label IN ('DISEASE', 'SYMPTOM', 'TREATMENT'))
SELECT doc_id, ord, text, label, s::INT AS s, e::INT AS e FROM v WHERE s >= 0 AND e > s AND e <= length(body) AND substring(body, s + 1, e - s) = text""")
def nr16_verbatim_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.verbatim(_entities(Views(spark, sf_dir)), LABELS).select("doc_id", "ord", "text", "label", F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))


@query(_E + """, k AS (SELECT *, CASE WHEN text = '' OR label NOT IN ('DISEASE', 'SYMPTOM', 'TREATMENT') THEN 'INVALID_ENTITY' WHEN coalesce(s >= 0 AND s < e AND e <= length(body) AND substring(body, s + 1, e - s) = text, false) THEN 'OK'
  WHEN strpos(substring(body, strpos(body, text) + 1), text) = 0 THEN 'OFFSET_CORRECTED' ELSE 'NON_VERBATIM_OR_AMBIGUOUS' END AS k FROM ents),
p AS (SELECT doc_id, ord, label, k, CASE k WHEN 'OFFSET_CORRECTED' THEN strpos(body, text) - 1 ELSE s END AS s, CASE k WHEN 'OFFSET_CORRECTED' THEN strpos(body, text) - 1 + length(text) ELSE e END AS e FROM k)
SELECT doc_id, ord, s::INT AS s, e::INT AS e, CASE WHEN k IN ('OK', 'OFFSET_CORRECTED') AND row_number() OVER (PARTITION BY doc_id, s, e, label, k IN ('OK', 'OFFSET_CORRECTED') ORDER BY ord) > 1 THEN 'DUPLICATE' ELSE k END AS status FROM p""")
def nr19_corrected_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = al.corrected_offsets(_entities(Views(spark, sf_dir)), LABELS, ["doc_id"], "ord")
    return out.select("doc_id", "ord", F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), "status")


@query("""WITH v AS (SELECT doc_id, s, e, max(label) AS new_label FROM gold GROUP BY ALL)
SELECT p.doc_id, p.s, p.e, p.label, v.new_label, CASE WHEN v.new_label IS NULL THEN 'VERIFIER_REJECTED' ELSE 'LABEL_CHANGED' END AS decision FROM predicted p LEFT JOIN v USING (doc_id, s, e) WHERE v.new_label IS NULL OR v.new_label <> p.label""")
def nr20_verifier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return al.verifier_changes(v.predicted, v.gold, ["doc_id", "s", "e"])


@query()
def nr18_align_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with and without offsets; tested by brute force."""
    v = Views(spark, sf_dir)
    mentions = _entities(v).select("doc_id", "ord", "text", "label", "start", "end")
    return al.align_given(v.table("documents").select("doc_id", "text"), mentions, LABELS, {"OTHER": "TREATMENT"})


_ITEMS = """SELECT doc_id, body, ord, CASE ord WHEN 2 THEN 'SYMPTOM' ELSE 'DISEASE' END AS category, upper(text) AS term, CASE WHEN doc_id % 2 = 0 THEN 'A1' END AS code, CASE WHEN ord = 1 THEN [{'start': s, 'end': e}, {'start': 0, 'end': 3}] END AS spans FROM ents"""


@query(_E + f""", i AS ({_ITEMS}), x AS (SELECT *, CASE WHEN ord = 1 THEN [0, 1] ELSE [0] END AS n FROM i WHERE term <> ''),
y AS (SELECT doc_id, body, ord, category, code, term, unnest(n) AS i, unnest(CASE WHEN spans IS NOT NULL THEN spans ELSE [{{'start': strpos(lower(body), lower(term)) - 1, 'end': strpos(lower(body), lower(term)) - 1 + length(term)}}] END) AS p FROM x)
SELECT doc_id, substring(body, p.start + 1, p.end - p.start) AS text, p.start::INT AS s, p.end::INT AS e, category, coalesce(code, '') AS code, term AS label, 'KEEP' AS action FROM y WHERE p.start >= 0 AND p.start < p.end AND p.end <= length(body) QUALIFY row_number() OVER (PARTITION BY doc_id, p.start, p.end ORDER BY ord, i) = 1""")
def nr27_annotation_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.when(F.col("ord") == 1, F.array(F.struct("start", "end"), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"))))
    items = _entities(Views(spark, sf_dir)).select("doc_id", "body", "ord", F.when(F.col("ord") == 2, "SYMPTOM").otherwise("DISEASE").alias("category"), F.upper("text").alias("term"), F.when(F.col("doc_id") % 2 == 0, "A1").alias("code"), F.lit(None).cast("string").alias("label"), spans.alias("spans"))
    out = al.annotation_seed(items)
    return out.select("doc_id", "text", F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), "category", "code", "label", "action")


@query()
def nr28_normalised_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations moved to unused hits, or the first error of a document; tested by brute force."""
    item = F.struct(F.col("text"), "start", "end", F.col("label").alias("category"), F.lit("").alias("code"), F.col("text").alias("label"), F.lit("EDIT").alias("action"))
    lists = _entities(Views(spark, sf_dir)).groupBy("doc_id").agg(F.first("body").alias("body"), F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return lists.select("doc_id", al.normalise_annotations(F.col("body"), F.col("items")).alias("r")).select("doc_id", F.size("r.annotations").alias("n"), "r.error")


@query("""WITH l AS (SELECT user_id % 40 AS doc_id, 'C-' || user_id % 7 AS code, event_type AS label FROM events WHERE event_id % 3 = 0), e AS (SELECT event_id, user_id % 40 AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'DISEASE' ELSE 'OTHER' END AS category, CASE WHEN event_id % 5 = 0 THEN 'c' || user_id % 9 ELSE '' END AS code, upper(event_type) || CASE WHEN value > 50 THEN ' x' ELSE '' END AS name FROM events)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = e.doc_id AND replace(lower(l.code), '-', '') = e.code) AND NOT (category = 'DISEASE' AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = e.doc_id AND l.label = lower(e.name)))""")
def nr33_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Views(spark, sf_dir).table("events")
    doc = (F.col("user_id") % 40).alias("doc_id")
    text = lambda c: c.cast("string")
    labels = events.where("event_id % 3 = 0").select(doc, F.concat(F.lit("C-"), text(F.col("user_id") % 7)).alias("code"), F.col("event_type").alias("label"))
    entries = events.select("event_id", doc, F.when(F.col("event_id") % 2 == 0, "DISEASE").otherwise("OTHER").alias("category"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("c"), text(F.col("user_id") % 9))).otherwise("").alias("code"), F.concat(F.upper("event_type"), F.when(F.col("value") > 50, " x").otherwise("")).alias("name"))
    return al.not_covered(entries, labels)


_SIDE = "SELECT doc_id, s AS start, e AS end_, 't' || s % 40 AS text, label AS category, CASE WHEN s % 3 = 0 THEN 'A' || s % 2 ELSE '' END AS code, CASE WHEN s % {d} = 0 THEN 'DELETE' ELSE 'KEEP' END AS action, s AS ord FROM {t}"


@query(f"""WITH a AS ({_SIDE.format(d=7, t="gold WHERE doc_id % 3 = 0")}), b AS ({_SIDE.format(d=11, t="gold WHERE doc_id % 3 = 0 AND s % 4 <> 0")}), d AS ({_SIDE.format(d=5, t="gold WHERE doc_id % 3 = 0 AND s % 6 = 0")}),
x AS (SELECT *, 0 AS late FROM a UNION ALL SELECT * REPLACE ('KEEP' AS action), 1 FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE (a.doc_id, a.start, a.end_, a.text) = (d.doc_id, d.start, d.end_, d.text))),
y AS (SELECT *, 0 AS late FROM b UNION ALL SELECT * REPLACE ('KEEP' AS action), 1 FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.doc_id, b.start, b.end_, b.text) = (d.doc_id, d.start, d.end_, d.text))),
p AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, text, category, lower(code) ORDER BY late, ord) = 1), q AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, text, category, lower(code) ORDER BY late, ord) = 1)
SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, coalesce(p.text, q.text) AS text, coalesce(p.category, q.category) AS category, lower(coalesce(p.code, q.code)) AS code,
  CASE WHEN p.doc_id IS NULL OR q.doc_id IS NULL OR p.action = 'DELETE' OR q.action = 'DELETE' THEN 'conflict' WHEN p.start = q.start AND p.end_ = q.end_ THEN 'agree' ELSE 'partial' END AS status
FROM p FULL JOIN q ON (p.doc_id, p.text, p.category, lower(p.code)) = (q.doc_id, q.text, q.category, lower(q.code))""")
def ev14_compared_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = Views(spark, sf_dir).gold.where("doc_id % 3 = 0")
    s = F.col("s")

    def side(df: DataFrame, d: int) -> DataFrame:
        return df.select("doc_id", s.alias("start"), F.col("e").alias("end"), F.concat(F.lit("t"), (s % 40).cast("string")).alias("text"), F.col("label").alias("category"), F.when(s % 3 == 0, F.concat(F.lit("A"), (s % 2).cast("string"))).otherwise("").alias("code"), F.when(s % d == 0, "DELETE").otherwise("KEEP").alias("action"), s.alias("ord"))

    return al.compared(side(gold, 7), side(gold.where("s % 4 <> 0"), 11), side(gold.where("s % 6 = 0"), 5)).select("doc_id", "text", "category", "code", "status")


_DECIDED = "SELECT event_id, user_id % 50 AS document_id, ['agree', 'partial', 'conflict'][(event_id % 3 + 1)::INT] AS status, ['expert_a', 'expert_b', 'custom', ''][(event_id % 4 + 1)::INT] AS decision, event_type AS a_label, CASE WHEN value > 80 THEN 'DELETE' ELSE 'KEEP' END AS a_action, CASE WHEN event_id % 5 > 0 THEN upper(event_type) END AS b_label, CASE WHEN value < 10 THEN 'DELETE' ELSE 'KEEP' END AS b_action FROM events"


def _decided(v: Views) -> DataFrame:
    n = F.col("event_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    a = F.struct(F.col("event_type").alias("label"), F.when(F.col("value") > 80, "DELETE").otherwise("KEEP").alias("action"))
    b = F.when(n % 5 > 0, F.struct(F.upper("event_type").alias("label"), F.when(F.col("value") < 10, "DELETE").otherwise("KEEP").alias("action")))
    return v.table("events").select("event_id", (F.col("user_id") % 50).alias("document_id"), pick(("agree", "partial", "conflict"), n % 3).alias("status"), pick((*al.DECISIONS, ""), n % 4).alias("decision"), a.alias("a"), b.alias("b"), F.lit("own").alias("custom"))


@query(f"""SELECT event_id, label FROM (SELECT event_id, CASE WHEN status = 'agree' THEN a_label WHEN decision = 'expert_a' THEN CASE WHEN a_action <> 'DELETE' THEN a_label END WHEN decision = 'expert_b' THEN CASE WHEN b_label IS NOT NULL AND b_action <> 'DELETE' THEN b_label END WHEN decision = 'custom' THEN 'own' END AS label FROM ({_DECIDED})) WHERE label IS NOT NULL""")
def ev15_final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.final_labels(_decided(Views(spark, sf_dir))).select("event_id", "label")


@query(f"""WITH d AS ({_DECIDED}), x AS (SELECT document_id, count(DISTINCT expert_id) AS experts FROM reviews WHERE expert_id < 12 GROUP BY document_id), o AS (SELECT document_id, count(*) AS open FROM d WHERE status <> 'agree' AND decision = '' GROUP BY document_id)
SELECT x.document_id, experts, coalesce(open, 0) AS open, CASE WHEN experts <> 2 THEN 'NEEDS_TWO_EXPERTS' WHEN open > 0 THEN 'UNRESOLVED' ELSE 'OK' END AS verdict FROM x LEFT JOIN o ON o.document_id = x.document_id""")
def ev16_adjudication_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return al.adjudication_guards(v.reviews.where("expert_id < 12"), _decided(v))


@query(_E + """, r AS (SELECT doc_id, body, ord, text, label, coalesce(s, 0) AS s, coalesce(e, length(text)) AS e FROM ents)
SELECT * FROM (SELECT doc_id, ord, text, label, s::INT AS s, e::INT AS e, CASE WHEN label NOT IN ('DISEASE', 'SYMPTOM', 'TREATMENT') THEN 'INVALID_LABEL' WHEN NOT (s >= 0 AND s < e AND e <= length(body)) THEN 'INVALID_OFFSETS' WHEN substring(body, s + 1, e - s) <> text THEN 'TEXT_MISMATCH'
  WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'OVERLAP' END AS fault FROM r) WHERE fault IS NOT NULL AND fault <> 'OVERLAP'""")
def ev19_integrity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults but overlaps, whose row among equal spans is not fixed; those are tested on small records."""
    rows = _entities(Views(spark, sf_dir)).withColumns({"start": F.coalesce("start", F.lit(0)), "end": F.coalesce("end", F.length("text"))})
    return al.integrity_faults(rows, LABELS).where("fault <> 'OVERLAP'").select("doc_id", "ord", "text", "label", F.col("start").alias("s"), F.col("end").alias("e"), "fault")


@query("""SELECT user_id % 50 AS document_id, user_id % 9 AS expert_id, count(*) AS drafts FROM events WHERE event_type = 'click' GROUP BY ALL""")
def mx05_gold_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by article and expert."""
    drafts = Views(spark, sf_dir).table("events").where("event_type = 'click'")
    return drafts.groupBy((F.col("user_id") % 50).alias("document_id"), (F.col("user_id") % 9).alias("expert_id")).agg(F.count(F.lit(1)).alias("drafts"))


_AI = "SELECT event_id AS doc_id, MAP {'Bệnh lý': [{'s': 0, 'e': 4}, {'s': user_id, 'e': user_id + 3}], 'Khác': [{'s': 1, 'e': 2}], 'Triệu chứng': CASE WHEN value > 50 THEN [{'s': 7, 'e': 9}] ELSE [] END} AS payload FROM events"


@query(f"""SELECT doc_id, CASE k WHEN 'Bệnh lý' THEN 'DISEASE' ELSE 'SYMPTOM' END AS label, x.s::INT AS s, x.e::INT AS e FROM (SELECT doc_id, k, unnest(v) AS x FROM (SELECT doc_id, unnest(map_keys(payload)) AS k, unnest(map_values(payload)) AS v FROM ({_AI})) WHERE k <> 'Khác')""")
def mx06_payload_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans out of a payload by category; categories without a label go."""
    span = lambda s, e: F.struct(F.lit(s).cast("int").alias("s") if isinstance(s, int) else s.cast("int").alias("s"), F.lit(e).cast("int").alias("e") if isinstance(e, int) else e.cast("int").alias("e"))
    u = F.col("user_id")
    none = F.array().cast("array<struct<s:int,e:int>>")
    payload = F.create_map(F.lit("Bệnh lý"), F.array(span(0, 4), span(u, u + 3)), F.lit("Khác"), F.array(span(1, 2)), F.lit("Triệu chứng"), F.when(F.col("value") > 50, F.array(span(7, 9))).otherwise(none))
    labels = F.create_map(F.lit("Bệnh lý"), F.lit("DISEASE"), F.lit("Triệu chứng"), F.lit("SYMPTOM"))
    each = Views(spark, sf_dir).table("events").select(F.col("event_id").alias("doc_id"), F.explode(payload).alias("k", "v"))
    return each.select("doc_id", labels[F.col("k")].alias("label"), F.explode("v").alias("x")).where("label IS NOT NULL").select("doc_id", "label", "x.s", "x.e")
