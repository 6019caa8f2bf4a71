"""Building a dictionary of terms: coded entries, aliases, the form hierarchy and the index of keys.

Everything is a projection, window or aggregation; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_by

#: The categories of the dictionary.
DISEASE, SYMPTOM, TRADITIONAL, UNUSED = "Bệnh Lý", "Triệu Chứng", "Đông Y / YHCT", "Không sử dụng NER"
#: Chapters whose codes name no finding, and the name of a form that says nothing.
UNUSED_CHAPTERS, GENERIC_FORM = "VWXYZ", "thể khác"
#: Sources by rank when one key and concept has several.
SOURCE_RANK = {"approved_alias": 4, "custom_alias": 3, "yhct": 2, "icd10": 1}
TERM = ("term", "category", "concept_id", "code", "label", "source", "alias_type")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_parentheses(name: Column) -> Column:
    return clean(F.regexp_replace(name, r"\s*\([^)]*\)", " "))


def qualifier(display_code: Column) -> Column:
    """dagger, asterisk or empty, by the mark in a displayed code."""
    return F.when(display_code.contains("†"), "dagger").when(display_code.contains("*"), "asterisk").otherwise("")


def code_category(code: Column) -> Column:
    """The category of a code by its chapter letter."""
    head = F.upper(F.substring(code, 1, 1))
    return F.when(head == "R", SYMPTOM).when(F.lit(UNUSED_CHAPTERS).contains(head) & (head != ""), UNUSED).otherwise(DISEASE)


def entity_type(code: Column) -> Column:
    """SYMPTOM or DISEASE label of a code; null where its chapter is not used."""
    category = code_category(F.replace(F.trim(code), F.lit("."), F.lit("")))
    return F.when(category == SYMPTOM, "SYMPTOM").when(category == DISEASE, "DISEASE")


def normal_category(value: Column) -> Column:
    """One of the three used categories for any spelling of it."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    traditional = raw.contains("yhct") | raw.contains("đông y") | raw.contains("dong y")
    return F.when(raw.isin("triệu chứng", "trieu chung", "symptom"), SYMPTOM).when(traditional, TRADITIONAL).otherwise(DISEASE)


def safe_aliases(name: Column) -> Column:
    """Aliases of a name: without what is in parentheses, and the common words for a malignant tumour."""
    plain = without_parentheses(name)
    bare = F.when((F.length(plain) >= 5) & (F.lower(plain) != F.lower(name)), plain)
    organ = without_parentheses(F.substring(name, F.length(F.regexp_extract(F.lower(name), "^(u ác (?:của |tính của )?)", 1)) + 1, F.length(name)))
    tumour = F.lower(name).startswith("u ác ") & (F.length(organ) >= 3) & ~organ.contains(",")
    return F.array_distinct(F.array_compact(F.array(bare, F.when(tumour, F.concat(F.lit("ung thư "), organ)), F.when(tumour, F.concat(F.lit("ung thư của "), organ)))))


def coded_entries(rows: DataFrame) -> DataFrame:
    """rows (row, code, display_code, name) as entries with an id of their own.

    The id is ICD10:code:qualifier (base without one); later rows with the same id get :rowN, so that
    repeated rows stay and can be traced. Rows without code or name are left out; see missing_fields."""
    full = rows.where("trim(code) <> '' AND trim(name) <> '' AND trim(display_code) <> ''")
    entries = full.select("row", clean(F.col("code")).alias("code"), clean(F.col("display_code")).alias("display_code"), clean(F.col("name")).alias("canonical_term"))
    marks = qualifier(F.col("display_code"))
    entries = entries.withColumn("qualifier", marks).withColumn("id", F.concat_ws(":", F.lit("ICD10"), "code", F.when(marks == "", "base").otherwise(marks)))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    entries = entries.withColumn("id", F.when(nth > 1, F.concat("id", F.lit(":row"), F.col("row").cast("string"))).otherwise(F.col("id")))
    category = code_category(F.col("code"))
    return entries.withColumns({"aliases": safe_aliases(F.col("canonical_term")), "category": category, "active": category != UNUSED, "ambiguous": F.lit(False)})


def missing_fields(rows: DataFrame) -> DataFrame:
    """Rows that coded_entries() leaves out."""
    return rows.where("coalesce(trim(code), '') = '' OR coalesce(trim(name), '') = '' OR coalesce(trim(display_code), '') = ''")


def carried(df: DataFrame, order: str, value: str, name: str, cell: int = 4096) -> DataFrame:
    """Add the last non-null value at or before each row in one whole-number order.

    Rows are dealt to cells of the order; a cell takes over what the cells before it leave, out of one
    row per cell, so the rows themselves never meet in one window."""
    cells = df.withColumn("_cell", F.floor(F.col(order) / cell))
    ends = cells.groupBy("_cell").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_cell", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    within = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.join(ends, "_cell").withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), "_before")).drop("_cell", "_before")


def form_hierarchy(rows: DataFrame) -> DataFrame:
    """rows (number, form_name, modern, traditional, code, icd_code) as base entries and their forms.

    A row with a form name is a form of the last base row before it; forms with the generic name are
    ambiguous and not used. A form without a base before it is left out; see sequence_faults."""
    base = F.when(F.col("form_name").isNull(), F.struct("number", "modern", "traditional"))
    placed = carried(rows.withColumn("_base", base), "number", "_base", "parent").drop("_base").where("parent IS NOT NULL")
    is_form = F.col("form_name").isNotNull()
    generic = is_form & (F.lower("form_name") == GENERIC_FORM)
    name = F.coalesce("form_name", F.concat("modern", F.lit(" ("), "traditional", F.lit(")")))
    ident = lambda c: F.concat(F.lit("YHCT:"), c.cast("string"))
    return placed.select(
        ident(F.col("number")).alias("id"), F.when(is_form, "clinical_form").otherwise("base").alias("record_type"), name.alias("canonical_term"), "code",
        F.when(~is_form, F.col("icd_code")).alias("icd_code"), F.when(is_form, ident(F.col("parent.number"))).alias("parent_id"),
        F.when(is_form, F.col("parent.modern")).alias("parent_modern"), F.when(is_form, F.col("parent.traditional")).alias("parent_traditional"),
        F.when(~is_form, F.col("modern")).alias("modern"), F.when(~is_form, F.col("traditional")).alias("traditional"), (~generic).alias("active"), generic.alias("ambiguous"),
    )


def sequence_faults(rows: DataFrame, first: int, count: int) -> DataFrame:
    """Numbers of first .. first + count - 1 that are MISSING or REPEATED in rows, and EXTRA ones."""
    want = rows.sparkSession.range(first, first + count).select(F.col("id").alias("number"), F.lit(True).alias("_want"))
    have = rows.groupBy(F.col("number").cast("long").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("n").isNull(), "MISSING").when(F.col("_want").isNull(), "EXTRA").when(F.col("n") > 1, "REPEATED")
    return want.join(have, "number", "full_outer").select("number", fault.alias("fault")).where("fault IS NOT NULL")


def coded_terms(entries: DataFrame) -> DataFrame:
    """TERM rows of coded entries: the name and each alias of what is active and not ambiguous."""
    names = F.concat(F.array(F.struct(F.col("canonical_term").alias("term"), F.lit("canonical").alias("alias_type"))), F.transform("aliases", lambda a: F.struct(a.alias("term"), F.lit("alias").alias("alias_type"))))
    used = entries.where("active AND NOT ambiguous").select("*", F.explode(names).alias("t"))
    return used.select("t.term", "category", F.col("id").alias("concept_id"), "code", F.col("canonical_term").alias("label"), F.lit("icd10").alias("source"), "t.alias_type")


def form_terms(entries: DataFrame, key) -> DataFrame:
    """TERM rows of a form hierarchy; key gives the match key of a column.

    A base has three terms: its name, its traditional name and its modern one, which keeps the disease
    code. A form stands alone only if one code has its key; with either name of its base it always does."""
    used = entries.where("active AND NOT ambiguous")
    term = lambda text, category, code, label, kind: F.struct(text.alias("term"), F.lit(category).alias("category"), code.alias("code"), label.alias("label"), F.lit(kind).alias("alias_type"))
    name, code = F.col("canonical_term"), F.col("code")
    three = F.array(term(name, TRADITIONAL, code, name, "canonical"), term(F.col("traditional"), TRADITIONAL, code, name, "alias"), term(F.col("modern"), DISEASE, F.col("icd_code"), F.col("modern"), "alias"))
    bases = used.where("record_type = 'base'").select("id", F.explode(three).alias("t"))
    forms = used.where("record_type = 'clinical_form'").withColumn("_key", key(name))
    alone = forms.groupBy("_key").agg(F.count_distinct("code").alias("_codes")).where("_codes = 1")
    single = forms.join(alone, "_key", "left_semi").select("id", term(name, TRADITIONAL, code, name, "clinical_form").alias("t"))
    joined = F.array(*[term(F.concat_ws(" ", F.col(p), name), TRADITIONAL, code, name, "clinical_form") for p in ("parent_traditional", "parent_modern")])
    composite = forms.select("id", F.explode(joined).alias("t"))
    every = bases.unionByName(single).unionByName(composite)
    return every.select("t.term", "t.category", F.col("id").alias("concept_id"), "t.code", "t.label", F.lit("yhct").alias("source"), "t.alias_type").where("term <> ''")


def key_index(terms: DataFrame, key, order: str) -> DataFrame:
    """TERM rows with their match key: one row per key and (concept, category), and how many share the key.

    The source of highest rank counts for a concept, of equal ones the last in `order`. A key with
    `concepts` = 1 can be assigned; others are only suggestions. Keys of one character or without a
    letter are left out."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.col("source")), F.lit(0))
    keyed = terms.withColumn("key", key(F.col("term"))).where((F.length("key") >= 2) & F.col("key").rlike(r"\p{L}"))
    keyed = keyed.withColumn("category", normal_category(F.col("category")))
    one = latest_by(keyed, ["key", "concept_id", "category"], [rank.desc(), F.desc(order)])
    return one.withColumn("concepts", F.count(F.lit(1)).over(Window.partitionBy("key")))


def accentless_index(index: DataFrame, plain) -> DataFrame:
    """plain, key and concept of keys without marks that name one (concept, category) in every spelling.

    Left out are those where no spelling has marks, or where some spelling is a single word."""
    rows = index.withColumn("plain", plain(F.col("key")))
    grouped = rows.groupBy("plain").agg(
        F.count_distinct("concept_id", "category").alias("_n"),
        F.bool_or(F.col("plain") != F.col("key")).alias("_marked"),
        F.bool_or(~F.col("key").contains(" ")).alias("_single"),
        F.min_by(F.struct("key", "concept_id", "category"), F.struct(-F.length("key"), "key")).alias("_c"),
    )
    return grouped.where("_n = 1 AND _marked AND NOT _single").select("plain", "_c.*")


def alias_guards(candidates: DataFrame, index: DataFrame, version: str) -> DataFrame:
    """Add `verdict` to alias candidates (key, concept_id, concept_code, status, version).

    The first that applies: ALREADY_PROCESSED, UNKNOWN_CONCEPT (neither id nor code is in the index),
    OLD_VERSION, CONFLICT (the key belongs to another concept), else OK."""
    folded = lambda c: F.nullif(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    names = index.select(F.explode(F.array_compact(F.array(folded("concept_id"), folded("code")))).alias("_name")).distinct()
    asked = candidates.withColumns({"_id": folded("concept_id"), "_code": folded("concept_code")})
    for c in ("_id", "_code"):
        asked = asked.join(names.select(F.col("_name").alias(c), F.lit(True).alias(f"_has{c}")), c, "left")
    holders = index.groupBy("key").agg(F.collect_set(F.struct(folded("concept_id").alias("a"), folded("code").alias("b"))).alias("_holders"))
    asked = asked.join(holders, "key", "left")
    same = lambda h: F.coalesce((h["a"] == F.col("_id")) | (h["a"] == F.col("_code")) | (h["b"] == F.col("_id")) | (h["b"] == F.col("_code")), F.lit(False))
    conflict = F.exists(F.coalesce("_holders", F.array()), lambda h: ~same(h))
    verdict = F.when(F.col("status") != "PENDING_REVIEW", "ALREADY_PROCESSED").when(F.coalesce("_has_id", "_has_code").isNull(), "UNKNOWN_CONCEPT")
    verdict = verdict.when((F.trim("version") != "") & (F.trim("version") != version), "OLD_VERSION").when(conflict, "CONFLICT").otherwise("OK")
    return asked.select(*candidates.columns, verdict.alias("verdict"))


def code_catalog(entries: DataFrame, order: str) -> DataFrame:
    """code (folded) and label of what is active and not ambiguous; of several the last in `order`."""
    used = entries.where("active AND NOT ambiguous AND trim(code) <> ''").withColumn("code", F.lower(F.trim("code")))
    return latest_by(used, ["code"], [F.desc(order)]).select("code", F.trim("canonical_term").alias("label"))


def gold_lexicon(annotations: DataFrame, term: str = "term", label: str = "label", key: str = "key") -> DataFrame:
    """key, term, label and frequency of annotated terms that always have one label.

    Terms that meet in one token key must agree on the label; the more frequent one names it (of equal
    ones the first by spelling)."""
    terms = annotations.groupBy(term, key).agg(F.count_distinct(label).alias("_n"), F.min(label).alias(label), F.count(F.lit(1)).alias("frequency")).where("_n = 1")
    labels = Window.partitionBy(key)
    agreed = terms.withColumn("_a", F.min(label).over(labels)).withColumn("_b", F.max(label).over(labels)).where("_a = _b")
    return latest_by(agreed, [key], [F.desc("frequency"), F.asc(term)]).select(key, term, label, "frequency")


def lexicon_with_prefix(terms: DataFrame, prefix: str) -> DataFrame:
    """Distinct terms in lower case, each also without the prefix word where it begins with it."""
    low = F.lower(clean(F.col("term")))
    both = F.array(low, F.when(low.startswith(prefix), F.trim(F.substring(low, len(prefix) + 1, F.length(low)))))
    return terms.select(F.explode(F.array_compact(both)).alias("term")).where("term <> ''").distinct()


def suffix_end(text: Column, end: Column, match_term: Column) -> Column:
    """The end of a span, moved over the punctuation that ends the dictionary's spelling if it follows there."""
    suffix = F.regexp_extract(F.coalesce(match_term, F.lit("")), r"([^\p{L}\p{N}_\s]+)\s*$", 1)
    follows = (suffix != "") & (F.substring(text, end + 1, F.length(suffix)) == suffix)
    return (end + F.when(follows, F.length(suffix)).otherwise(0)).cast("int")


def first_code(payload: Column) -> Column:
    """code and label of the first item with a code, in payload order.

    payload is an array of (items: array of (code, label, term)) in the order of the source."""
    items = F.filter(F.flatten(F.transform(payload, lambda g: g["items"])), lambda x: F.trim(F.coalesce(x["code"], F.lit(""))) != "")
    x = F.get(items, F.lit(0))
    label = F.nullif(F.trim(F.coalesce(F.nullif(x["label"], F.lit("")), x["term"], F.lit(""))), F.lit(""))
    return F.when(F.size(items) > 0, F.struct(F.trim(x["code"]).alias("code"), label.alias("label")))
