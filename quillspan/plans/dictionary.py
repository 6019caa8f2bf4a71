"""Dictionary build, loaders and the index of keys, on entries that stand on the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as d
from ..registry import query
from .views import Views

#: Entries on the part table: codes of several chapters that repeat, names with parentheses and prefixes.
_ROWS = """SELECT p_partkey AS row, ['A', 'B', 'R', 'V', 'Z'][(p_partkey % 5 + 1)::INT] || lpad((p_partkey % 37)::VARCHAR, 2, '0') AS code,
  ['A', 'B', 'R', 'V', 'Z'][(p_partkey % 5 + 1)::INT] || lpad((p_partkey % 37)::VARCHAR, 2, '0') || CASE p_size % 3 WHEN 0 THEN '†' WHEN 1 THEN '*' ELSE '' END AS display_code,
  CASE p_partkey % 7 WHEN 0 THEN 'u ác của ' WHEN 1 THEN 'U ác ' ELSE '' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (' || p_type || ')' ELSE '' END || CASE WHEN p_partkey % 21 = 0 THEN ', x' ELSE '' END AS name FROM part"""
_CATEGORY = "CASE WHEN substring(code, 1, 1) = 'R' THEN 'Triệu Chứng' WHEN substring(code, 1, 1) IN ('V', 'W', 'X', 'Y', 'Z') THEN 'Không sử dụng NER' ELSE 'Bệnh Lý' END"
_ENTRIES = f"""SELECT row, code, display_code, name AS canonical_term, qualifier, {_CATEGORY} AS category, substring(code, 1, 1) NOT IN ('V', 'W', 'X', 'Y', 'Z') AS active,
  'ICD10:' || code || ':' || coalesce(nullif(qualifier, ''), 'base') || CASE WHEN row_number() OVER (PARTITION BY code, qualifier ORDER BY row) > 1 THEN ':row' || row ELSE '' END AS id
FROM (SELECT *, CASE WHEN contains(display_code, '†') THEN 'dagger' WHEN contains(display_code, '*') THEN 'asterisk' ELSE '' END AS qualifier FROM ({_ROWS}))"""
_ALIASES = r"""SELECT id, code, category, active, canonical_term, unnest(list_distinct(list_filter([CASE WHEN length(plain) >= 5 AND lower(plain) <> lower(canonical_term) THEN plain END,
  CASE WHEN tumour THEN 'ung thư ' || organ END, CASE WHEN tumour THEN 'ung thư của ' || organ END], lambda x: x IS NOT NULL))) AS alias
FROM (SELECT *, lower(canonical_term) LIKE 'u ác %' AND length(organ) >= 3 AND NOT contains(organ, ',') AS tumour FROM (SELECT *, trim(regexp_replace(regexp_replace(canonical_term, '\s*\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(regexp_replace(canonical_term, '^[uU] ác (của |tính của )?', ''), '\s*\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS organ FROM entries))"""
_FORMS = """SELECT p_partkey AS number, CASE WHEN p_partkey % 6 = 1 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Thể Khác' ELSE p_brand END AS form_name, p_name AS modern, p_type AS traditional, 'U' || p_partkey AS code, 'A' || p_size AS icd_code FROM part"""
_TREE = """SELECT 'YHCT:' || number AS id, CASE WHEN form_name IS NULL THEN 'base' ELSE 'clinical_form' END AS record_type, coalesce(form_name, modern || ' (' || traditional || ')') AS canonical_term, code,
  CASE WHEN form_name IS NULL THEN icd_code END AS icd_code, CASE WHEN form_name IS NOT NULL THEN 'YHCT:' || p.number END AS parent_id, CASE WHEN form_name IS NOT NULL THEN p.modern END AS parent_modern,
  CASE WHEN form_name IS NOT NULL THEN p.traditional END AS parent_traditional, CASE WHEN form_name IS NULL THEN r.modern END AS modern, CASE WHEN form_name IS NULL THEN r.traditional END AS traditional,
  coalesce(lower(form_name), '') <> 'thể khác' AS active, coalesce(lower(form_name), '') = 'thể khác' AS ambiguous
FROM (SELECT *, last_value(CASE WHEN form_name IS NULL THEN {'number': number, 'modern': modern, 'traditional': traditional} END IGNORE NULLS) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS p FROM forms) r WHERE p IS NOT NULL"""
_KEY = r"array_to_string(regexp_extract_all(lower(%s), '[\p{L}\p{N}]+'), ' ')"
_ICD_TERMS = "SELECT canonical_term AS term, category, id AS concept_id, code, canonical_term AS label, 'icd10' AS source, 'canonical' AS alias_type FROM entries WHERE active UNION ALL SELECT alias, category, id, code, canonical_term, 'icd10', 'alias' FROM aliases_of WHERE active"
_FORM_TERMS = f"""WITH used AS (SELECT * FROM tree WHERE active AND NOT ambiguous), one AS (SELECT {_KEY % 'canonical_term'} AS k FROM used WHERE record_type = 'clinical_form' GROUP BY k HAVING count(DISTINCT code) = 1)
SELECT canonical_term AS term, 'Đông Y / YHCT' AS category, id AS concept_id, code, canonical_term AS label, 'yhct' AS source, 'canonical' AS alias_type FROM used WHERE record_type = 'base'
UNION ALL SELECT traditional, 'Đông Y / YHCT', id, code, canonical_term, 'yhct', 'alias' FROM used WHERE record_type = 'base'
UNION ALL SELECT modern, 'Bệnh Lý', id, icd_code, modern, 'yhct', 'alias' FROM used WHERE record_type = 'base'
UNION ALL SELECT canonical_term, 'Đông Y / YHCT', id, code, canonical_term, 'yhct', 'clinical_form' FROM used WHERE record_type = 'clinical_form' AND {_KEY % 'canonical_term'} IN (SELECT k FROM one)
UNION ALL SELECT unnest([parent_traditional || ' ' || canonical_term, parent_modern || ' ' || canonical_term]), 'Đông Y / YHCT', id, code, canonical_term, 'yhct', 'clinical_form' FROM used WHERE record_type = 'clinical_form'"""


def _with(*names: str) -> str:
    parts = {"entries": _ENTRIES, "aliases_of": _ALIASES, "forms": _FORMS, "tree": _TREE, "icd_terms": _ICD_TERMS, "form_terms": _FORM_TERMS}
    return "WITH " + ", ".join(f"{n} AS ({parts[n]})" for n in parts if n in names) + " "


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part")
    key = F.col("p_partkey")
    code = F.concat(F.element_at(F.array(*map(F.lit, "ABRVZ")), (key % 5 + 1).cast("int")), F.lpad((key % 37).cast("string"), 2, "0"))
    mark = F.when(F.col("p_size") % 3 == 0, "†").when(F.col("p_size") % 3 == 1, "*").otherwise("")
    name = F.concat(F.when(key % 7 == 0, "u ác của ").when(key % 7 == 1, "U ác ").otherwise(""), "p_name", F.when(key % 4 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""), F.when(key % 21 == 0, ", x").otherwise(""))
    return part.select(key.alias("row"), code.alias("code"), F.concat(code, mark).alias("display_code"), name.alias("name"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    form = F.when(key % 6 == 1, None).when(key % 5 == 0, "Thể Khác").otherwise(F.col("p_brand"))
    return Views(spark, sf_dir).table("part").select(key.alias("number"), form.alias("form_name"), F.col("p_name").alias("modern"), F.col("p_type").alias("traditional"), F.concat(F.lit("U"), key.cast("string")).alias("code"), F.concat(F.lit("A"), F.col("p_size").cast("string")).alias("icd_code"))


def _key(text):
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


@query(_with("entries") + "SELECT id, row, code, display_code, canonical_term, qualifier, category, active FROM entries")
def dx01_coded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.coded_entries(_rows(spark, sf_dir)).select("id", "row", "code", "display_code", "canonical_term", "qualifier", "category", "active")


@query(_with("forms", "tree") + "SELECT * FROM tree")
def dx02_form_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.form_hierarchy(_forms(spark, sf_dir))


@query("""SELECT coalesce(w.number, h.number)::BIGINT AS number, CASE WHEN h.n IS NULL THEN 'MISSING' WHEN w.number IS NULL THEN 'EXTRA' ELSE 'REPEATED' END AS fault
FROM (SELECT unnest(range(10, 160)) AS number) w FULL JOIN (SELECT p_size * 3 AS number, count(*) AS n FROM part GROUP BY ALL) h USING (number) WHERE h.n IS NULL OR w.number IS NULL OR h.n > 1""")
def dx02_sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.sequence_faults(Views(spark, sf_dir).table("part").select((F.col("p_size") * 3).alias("number")), 10, 150)


@query(_with("entries", "aliases_of", "icd_terms") + "SELECT * FROM icd_terms")
def dx05_coded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.coded_terms(d.coded_entries(_rows(spark, sf_dir)))


@query(_with("forms", "tree", "form_terms") + "SELECT * FROM form_terms")
def dx06_form_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.form_terms(d.form_hierarchy(_forms(spark, sf_dir)), _key)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = d.coded_terms(d.coded_entries(_rows(spark, sf_dir))).unionByName(d.form_terms(d.form_hierarchy(_forms(spark, sf_dir)), _key))
    return d.key_index(terms.withColumn("ord", F.concat_ws("|", "term", "code", "alias_type")), _key, "ord")


_INDEX = f"""(SELECT *, count(*) OVER (PARTITION BY key) AS concepts FROM (SELECT * FROM (SELECT *, {_KEY % 'term'} AS key, term || '|' || code || '|' || alias_type AS ord FROM (SELECT * FROM icd_terms UNION ALL SELECT * FROM form_terms)) WHERE length(key) >= 2
  QUALIFY row_number() OVER (PARTITION BY key, concept_id, category ORDER BY CASE source WHEN 'yhct' THEN 2 ELSE 1 END DESC, ord DESC) = 1))"""
_ALL = _with("entries", "aliases_of", "forms", "tree", "icd_terms", "form_terms")


@query(_ALL + f"SELECT key, concept_id, category, code, term, source, alias_type, concepts FROM {_INDEX}")
def dx06_key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("key", "concept_id", "category", "code", "term", "source", "alias_type", "concepts")


@query(_ALL + f"""SELECT plain, c.key AS key, c.concept_id AS concept_id, c.category AS category FROM (SELECT plain, arg_min({{'key': key, 'concept_id': concept_id, 'category': category}}, (-length(key), key)) AS c
  FROM (SELECT *, translate(key, 'áàảãạủ', 'aaaaau') AS plain FROM {_INDEX}) GROUP BY plain HAVING count(DISTINCT (concept_id, category)) = 1 AND bool_or(plain <> key) AND NOT bool_or(NOT contains(key, ' ')))""")
def dx07_accentless_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.accentless_index(_index(spark, sf_dir), lambda c: F.translate(c, "áàảãạủ", "aaaaau"))


@query(_ALL + f"""SELECT c.ord, c.key, CASE WHEN status <> 'PENDING_REVIEW' THEN 'ALREADY_PROCESSED' WHEN NOT EXISTS (SELECT 1 FROM {_INDEX} i WHERE lower(c.concept_id) IN (lower(i.concept_id), lower(i.code)) OR lower(c.concept_code) IN (lower(i.concept_id), lower(i.code))) THEN 'UNKNOWN_CONCEPT'
  WHEN version NOT IN ('', 'v1') THEN 'OLD_VERSION' WHEN EXISTS (SELECT 1 FROM {_INDEX} i WHERE i.key = c.key AND NOT (lower(i.concept_id) IN (lower(c.concept_id), lower(c.concept_code)) OR lower(i.code) IN (lower(c.concept_id), lower(c.concept_code)))) THEN 'CONFLICT' ELSE 'OK' END AS verdict
FROM (SELECT p_partkey AS ord, {_KEY % "p_type || ' ' || p_brand"} AS key, 'yhct:' || (p_partkey - p_partkey % 2) AS concept_id, 'U' || p_partkey * 2 AS concept_code, CASE WHEN p_size % 9 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status, CASE WHEN p_size % 11 = 0 THEN 'v0' WHEN p_size % 2 = 0 THEN '' ELSE 'v1' END AS version FROM part) c""")
def dx12_alias_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    asked = Views(spark, sf_dir).table("part").select(n.alias("ord"), _key(F.concat_ws(" ", "p_type", "p_brand")).alias("key"), F.concat(F.lit("yhct:"), text(n - n % 2)).alias("concept_id"), F.concat(F.lit("U"), text(n * 2)).alias("concept_code"), F.when(size % 9 == 0, "APPROVED").otherwise("PENDING_REVIEW").alias("status"), F.when(size % 11 == 0, "v0").when(size % 2 == 0, "").otherwise("v1").alias("version"))
    return d.alias_guards(asked, _index(spark, sf_dir), "v1").select("ord", "key", "verdict")


@query(_with("entries") + "SELECT lower(code) AS code, arg_max(canonical_term, row) AS label FROM entries WHERE active GROUP BY lower(code)")
def dx13_code_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.code_catalog(d.coded_entries(_rows(spark, sf_dir)), "row")


_NOTES = f"SELECT p_name AS term, {_KEY % 'lower(p_name)'} AS key, ['DISEASE', 'SYMPTOM', 'TREATMENT'][(p_size % 3 + 1)::INT] AS label FROM part UNION ALL SELECT upper(p_name) || '!', {_KEY % 'lower(p_name)'}, ['DISEASE', 'SYMPTOM'][(length(p_type) % 2 + 1)::INT] FROM part WHERE p_partkey % 3 = 0"


@query(f"""WITH n AS ({_NOTES}), t AS (SELECT term, key, min(label) AS label, count(*) AS frequency FROM n GROUP BY term, key HAVING count(DISTINCT label) = 1)
SELECT key, term, label, frequency FROM t WHERE key IN (SELECT key FROM t GROUP BY key HAVING count(DISTINCT label) = 1) QUALIFY row_number() OVER (PARTITION BY key ORDER BY frequency DESC, term) = 1""")
def dx14_gold_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    plain = part.select(F.col("p_name").alias("term"), _key(F.col("p_name")).alias("key"), pick(("DISEASE", "SYMPTOM", "TREATMENT"), F.col("p_size") % 3).alias("label"))
    loud = part.where("p_partkey % 3 = 0").select(F.concat(F.upper("p_name"), F.lit("!")).alias("term"), _key(F.col("p_name")).alias("key"), pick(("DISEASE", "SYMPTOM"), F.length("p_type") % 2).alias("label"))
    return d.gold_lexicon(plain.unionByName(loud))


@query(r"""WITH t AS (SELECT p_partkey, 'x ' || p_name || CASE p_size % 3 WHEN 0 THEN ').' WHEN 1 THEN '(' ELSE '' END AS text, 2 + length(p_name) AS e, p_name || CASE p_size % 2 WHEN 0 THEN ')' ELSE ' ' END AS term FROM part)
SELECT p_partkey, (e + CASE WHEN regexp_extract(term, '([^\p{L}\p{N}_\s]+)\s*$', 1) <> '' AND starts_with(substring(text, e + 1), regexp_extract(term, '([^\p{L}\p{N}_\s]+)\s*$', 1)) THEN length(regexp_extract(term, '([^\p{L}\p{N}_\s]+)\s*$', 1)) ELSE 0 END)::INT AS stop FROM t""")
def fn22_suffix_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    text = F.concat(F.lit("x "), name, F.when(size % 3 == 0, ").").when(size % 3 == 1, "(").otherwise(""))
    term = F.concat(name, F.when(size % 2 == 0, ")").otherwise(" "))
    return Views(spark, sf_dir).table("part").select("p_partkey", d.suffix_end(text, F.length(name) + 2, term).alias("stop"))


@query(_with("entries", "aliases_of") + "SELECT id, alias FROM aliases_of")
def fn23_safe_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.coded_entries(_rows(spark, sf_dir)).select("id", F.explode("aliases").alias("alias"))


@query(f"SELECT row, code, {_CATEGORY} AS category, CASE {_CATEGORY} WHEN 'Triệu Chứng' THEN 'SYMPTOM' WHEN 'Bệnh Lý' THEN 'DISEASE' END AS kind FROM ({_ROWS})")
def fn24_code_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and label of a code; also the legacy mapping to DISEASE, SYMPTOM or nothing."""
    return _rows(spark, sf_dir).select("row", "code", d.code_category(F.col("code")).alias("category"), d.entity_type(F.col("code")).alias("kind"))


@query(f"SELECT row, CASE WHEN contains(display_code, '†') THEN 'dagger' WHEN contains(display_code, '*') THEN 'asterisk' ELSE '' END AS qualifier FROM ({_ROWS})")
def fn25_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row", d.qualifier(F.col("display_code")).alias("qualifier"))


_SPELLED = "SELECT p_partkey, ['Trieu Chung', ' symptom', 'dong y', 'YHCT x', 'Bệnh', NULL][(p_size % 6 + 1)::INT] AS raw FROM part"


@query(f"SELECT p_partkey, CASE WHEN lower(trim(coalesce(raw, ''))) IN ('triệu chứng', 'trieu chung', 'symptom') THEN 'Triệu Chứng' WHEN raw IN ('dong y', 'YHCT x') THEN 'Đông Y / YHCT' ELSE 'Bệnh Lý' END AS category FROM ({_SPELLED})")
def fn26_normal_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("Trieu Chung"), F.lit(" symptom"), F.lit("dong y"), F.lit("YHCT x"), F.lit("Bệnh"), F.lit(None)), (F.col("p_size") % 6 + 1).cast("int"))
    return Views(spark, sf_dir).table("part").select("p_partkey", d.normal_category(raw).alias("category"))


_PAYLOAD = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'C' || l_partkey ELSE '' END AS code, CASE WHEN l_suppkey % 2 = 0 THEN 'L' || l_suppkey ELSE '' END AS label, 'T' || l_partkey AS term, l_partkey, l_suppkey, l_extendedprice FROM lineitem"


@query(f"""SELECT l_orderkey, x.code AS code, x.label AS label FROM (SELECT l_orderkey, arg_min({{'code': code, 'label': coalesce(nullif(label, ''), term)}}, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (code <> '') AS x FROM ({_PAYLOAD}) GROUP BY l_orderkey)""")
def fn46_first_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item with a code in payload order; null where none has one."""
    item = F.struct(F.when(F.col("l_quantity") > 25, F.concat(F.lit("C"), F.col("l_partkey").cast("string"))).otherwise("").alias("code"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("L"), F.col("l_suppkey").cast("string"))).otherwise("").alias("label"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("term"))
    lines = Views(spark, sf_dir).table("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("item")).alias("x"))
    payload = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("l_orderkey", F.array(F.struct(F.transform("xs", lambda x: x["item"]).alias("items"))).alias("payload"))
    return payload.select("l_orderkey", d.first_code(F.col("payload")).alias("x")).select("l_orderkey", "x.code", "x.label")


@query("SELECT DISTINCT unnest(list_filter([t, CASE WHEN starts_with(t, 'red ') THEN trim(substring(t, 5)) END], lambda x: x IS NOT NULL)) AS term FROM (SELECT lower(p_name || ' ' || p_size) AS t FROM part)")
def mx16_lexicon_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("term"))
    return d.lexicon_with_prefix(part, "red ")
