"""Training records, error patterns and evaluation of systems on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matching, records
from ..registry import query
from .annotation import _COUNTS, _TAGS, _span_arrays, _tags
from .views import Views

PHRASES = {"the": "thé", "of the": "of thé", "und": "ünd"}


@query()
def tk10_packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document packed into chunks of 2,000 characters; tested by brute force."""
    lines = Views(spark, sf_dir).table("documents").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.length(x) + 1).alias("sizes"))
    each = lines.select("doc_id", F.arrays_zip("sizes", records.packed_chunks(F.col("sizes"), 2000).alias("chunk")).alias("z")).select("doc_id", F.explode("z").alias("z"))
    return each.groupBy("doc_id", F.col("z.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("z.sizes").alias("size"))


_SIGNS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(f"""WITH t AS (SELECT doc_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS token FROM (SELECT doc_id, {_SIGNS} AS a FROM documents)),
g AS (SELECT *, CASE WHEN lag(token) OVER w IS NULL OR token IN ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}', '…') OR lag(token) OVER w IN ('(', '[', '{{') THEN 0 ELSE 1 END AS gap FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, token, (sum(gap + length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM g""")
def fn18_detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))
    tokens = Views(spark, sf_dir).table("documents").select("doc_id", F.posexplode(words).alias("pos", "token"))
    return records.detokenised(tokens).select("doc_id", "pos", "token", F.col("end").alias("e"))


def _twice(sql: str, pattern: str, new: str) -> str:
    once = f"regexp_replace({sql}, '{pattern}', '{new}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{new}', 'g')"


_W = r"[\p{L}\p{N}_]"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g')"
_CLEAN = _twice(_CLEAN, rf"({_W})-\s+({_W})", r"\1-\2")
_CLEAN = rf"regexp_replace({_CLEAN}, '({_W})\.\s+((?i:com|org|io|net|edu|gov)\b)', '\1.\2', 'g')"
_CLEAN = _twice(_CLEAN, r"(\d)\s+(\d\d\d\b)", r"\1\2")
_CLEAN = rf"trim(regexp_replace(regexp_replace({_CLEAN}, '\s*/\s*', '/', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT page_id, {_CLEAN} AS cleaned FROM pages")
def fn10_clean_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Views(spark, sf_dir).table("pages")
    return pages.select("page_id", records.clean_extracted(records.nfc(F.col("html"))).alias("cleaned"))


@query()
def fn07_restored_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in their toned spelling, the longest first; tested by brute force."""
    return Views(spark, sf_dir).table("documents").select("doc_id", F.sha2(records.restore_tones(F.col("text"), PHRASES), 256).alias("restored"))


@query()
def nr31_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged documents in chunks of 50 pieces that cut no entity; tested by brute force."""
    v = Views(spark, sf_dir)
    rows = _tags(v).join(v.tokens, ["doc_id", "pos"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", F.length("token").alias("n")))).alias("a"))
    out = records.chunked_sentences(F.transform("a", lambda x: x["tag"]), F.transform("a", lambda x: x["n"]), 50)
    return rows.select("doc_id", out.alias("r")).select("doc_id", F.size("r.ranges").alias("chunks"), "r.error")


@query(f"""WITH t AS ({_TAGS}), l AS (SELECT *, CASE WHEN tag <> 'O' THEN substring(tag, 3) END AS label, (pos % 10) / 10.0 AS score FROM t),
o AS (SELECT *, label IS NOT NULL AND (tag LIKE 'B-%' OR lag(label) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM label) AS opens FROM l),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, any_value(label) AS label, round(avg(score), 6) AS score FROM i WHERE label IS NOT NULL GROUP BY doc_id, island HAVING avg(score) >= 0.45""")
def nr30_word_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tags(Views(spark, sf_dir)).withColumn("score", F.col("pos") % 10 / 10)
    return records.word_entities(words, 0.45).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT DISTINCT doc_id, s, e, label FROM predicted), x AS (SELECT t.doc_id, t.pos, arg_min({'s': s.s, 'label': s.label}, (s.s, s.e, s.label)) AS x FROM tokens t JOIN s ON s.doc_id = t.doc_id AND s.s <= t.pos AND t.pos + 1 <= s.e GROUP BY ALL)
SELECT t.doc_id, t.pos, coalesce(CASE WHEN x.x.s = t.pos THEN 'B-' ELSE 'I-' END || x.x.label, 'IGN') AS tag FROM tokens t LEFT JOIN x USING (doc_id, pos)""")
def nr22_strict_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    tokens = v.tokens.select("doc_id", "pos", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return records.strict_bio(tokens, v.predicted)[0].select("doc_id", "pos", "tag")


@query("""WITH s AS (SELECT DISTINCT doc_id, s, e, label FROM predicted), x AS (SELECT t.doc_id, t.pos, count(*) AS n, arg_min({'s': s.s, 'e': s.e, 'label': s.label}, (s.s, s.e, s.label)) AS x FROM tokens t JOIN s ON s.doc_id = t.doc_id AND s.s <= t.pos AND t.pos + 1 <= s.e GROUP BY ALL)
SELECT doc_id, 'TOKEN_MULTI_ENTITY' AS type, pos AS start FROM x WHERE n > 1 UNION ALL SELECT doc_id, 'ENTITY_NOT_TOKEN_ALIGNED', s FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = s.doc_id AND (x.x.s, x.x.e, x.x.label) = (s.s, s.e, s.label))""")
def nr22_bio_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    tokens = v.tokens.select("doc_id", "pos", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return records.strict_bio(tokens, v.predicted)[1]


@query()
def ds07_sentence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of eight letters or more as spans in their sentences; tested on small texts."""
    docs = Views(spark, sf_dir).table("documents").select("doc_id", "text")
    first = docs.select("doc_id", (F.instr("text", F.regexp_extract("text", "[a-z]{8,}", 0)) - 1).alias("s"), F.length(F.regexp_extract("text", "[a-z]{8,}", 0)).alias("n")).where("n > 0")
    return records.sentence_records(docs, first.select("doc_id", "s", (F.col("s") + F.col("n")).alias("e"), F.lit("WORD").alias("label"))).select("doc_id", "sentence", "s", "e", "label")


_LOGS = """SELECT event_id AS id, ['LABEL_ERROR', 'BOUNDARY_ERROR', 'FP', 'FN'][(event_id % 4 + 1)::INT] AS error_type, event_type AS pred_label, upper(event_type) || '  ' || user_id % 6 AS pred_text, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE 'error' END AS gold_label, 'G ' || user_id % 9 AS gold_text, (value::INT % 3)::BIGINT AS round, props || repeat('x', (event_id % 7)::INT) AS sentence FROM events"""
_KEYED = f"""SELECT *, CASE error_type WHEN 'BOUNDARY_ERROR' THEN concat_ws('|', error_type, pred_label, gold_label, lower(gold_text)) WHEN 'LABEL_ERROR' THEN concat_ws('|', error_type, lower(gold_text), pred_label, gold_label)
  WHEN 'FP' THEN concat_ws('|', error_type, trim(regexp_replace(lower(pred_text), '\\s+', ' ', 'g')), pred_label) ELSE concat_ws('|', error_type, lower(gold_text), gold_label) END AS pattern_key FROM ({_LOGS})"""


def _errors(v: Views) -> DataFrame:
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, records.ERROR_TYPES)), (n % 4 + 1).cast("int"))
    text = lambda c: c.cast("string")
    rows = v.table("events").select(n.alias("id"), kind.alias("error_type"), F.col("event_type").alias("pred_label"), F.concat(F.upper("event_type"), F.lit("  "), text(F.col("user_id") % 6)).alias("pred_text"), F.when(n % 3 == 0, "view").otherwise("error").alias("gold_label"), F.concat(F.lit("G "), text(F.col("user_id") % 9)).alias("gold_text"), (F.bround("value").cast("int") % 3).cast("long").alias("round"), F.concat("props", F.repeat(F.lit("x"), (n % 7).cast("int"))).alias("sentence"))
    key = records.pattern_key(F.col("error_type"), F.col("pred_label"), F.col("pred_text"), F.col("gold_label"), F.col("gold_text"))
    return rows.withColumn("pattern_key", key).withColumn("label", F.col("gold_label"))


@query(f"SELECT id, pattern_key FROM ({_KEYED})")
def ev11_pattern_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(Views(spark, sf_dir)).select("id", "pattern_key")


@query(f"""SELECT pattern_key, count(*) AS frequency, max(round) AS latest_round, arg_max(id, (round, length(sentence), -id)) AS id, arg_max(gold_label, (round, length(sentence), -id)) AS label FROM ({_KEYED}) GROUP BY pattern_key""")
def wn13_error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.error_patterns(_errors(Views(spark, sf_dir))).drop("error_type")


@query()
def tk08_diverse_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty patterns that cover types and labels; tested by brute force."""
    return records.diverse_patterns(records.error_patterns(_errors(Views(spark, sf_dir))), 20, ("view", "error"))


@query(f"""WITH {_COUNTS} SELECT 'WIDE' AS system, label, tp, fp, fn, precision, recall, f1, tp + fn AS support FROM m
UNION ALL SELECT 'GOLD', label, count(*), 0, 0, 1.0, 1.0, 1.0, count(*) FROM gold GROUP BY label""")
def ev12_systems_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system against the gold spans, exact, with support; the gold itself scores 1."""
    v = Views(spark, sf_dir)
    keys = ["doc_id", "s", "e", "label"]
    out = None
    for name, spans in (("WIDE", v.predicted), ("GOLD", v.gold)):
        rows = matching.metrics(matching.exact_counts(spans, v.gold, keys)).withColumn("support", F.col("tp") + F.col("fn")).withColumn("system", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def ev12_systems_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched spans by document at half overlap, one to one; the matching is tested by brute force."""
    arrays = _span_arrays(Views(spark, sf_dir))
    pairs = matching.match_spans(F.col("predicted"), F.col("gold"), "greedy")
    return arrays.select("doc_id", F.size(pairs).alias("tp"), F.size(F.coalesce("predicted", F.array())).alias("n_pred"), F.size(F.coalesce("gold", F.array())).alias("n_gold"))


@query()
def ev08_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by type, same spans first and then the best overlap of any label; tested by brute force."""
    arrays = _span_arrays(Views(spark, sf_dir))
    each = arrays.select("doc_id", F.explode(matching.type_errors(F.col("predicted"), F.col("gold"), "patterns")).alias("x"))
    return each.groupBy("x.type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("""SELECT vec_id // 3 AS word, ['O', 'B-X', 'I-X', 'B-Y', 'I-Y', 'B-Z', 'I-Z', 'IGN'][list_position(s, list_max(s))] AS tag FROM (SELECT vec_id, embedding[1:8] AS s FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id) = 1""")
def mx13_word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first piece of each word decides its tag."""
    pieces = Views(spark, sf_dir).table("embeddings").select(F.lit(0).alias("sentence"), F.floor(F.col("vec_id") / 3).alias("word"), F.col("vec_id").alias("piece"), F.slice("embedding", 1, 8).alias("scores"))
    return records.word_tags(pieces, ["O", "B-X", "I-X", "B-Y", "I-Y", "B-Z", "I-Z", "IGN"]).select("word", "tag")


@query("""WITH g AS (SELECT doc_id AS id, doc_id * 2 AS ord FROM documents), p AS (SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS id, doc_id * 2 AS ord, lang AS value FROM labels JOIN documents USING (doc_id))
SELECT g.id, g.ord, coalesce(a.value, b.value) AS value FROM g LEFT JOIN p a ON a.id = g.id LEFT JOIN p b ON b.id IS NULL AND b.ord = g.ord""")
def jn13_joined_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    docs = v.table("documents")
    gold = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("ord"))
    predictions = v.table("labels").select("doc_id").join(docs, "doc_id").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("id"), (F.col("doc_id") * 2).alias("ord"), F.col("lang").alias("value"))
    return records.joined_by_id(gold, predictions)


@query("SELECT doc_id, source FROM documents WHERE NOT (contains(text, '|') OR n_chars < 100) AND NOT (source = 'src1' AND n_chars < 1000)")
def ds04_safe_for_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without flags; of one source also those whose scheme may miss labels go."""
    docs = Views(spark, sf_dir).table("documents")
    flagged = F.col("text").contains("|") | (F.col("n_chars") < 100)
    return docs.where(~flagged & ~((F.col("source") == "src1") & (F.col("n_chars") < 1000))).select("doc_id", "source")


@query("""SELECT doc_id, phrase FROM (SELECT doc_id, text, unnest(['tion', 'zzzz', 'the ', 'und ']) AS phrase FROM documents) WHERE NOT contains(text, phrase)""")
def mx17_missing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a gold list that a document does not have: no rows would mean a sound list."""
    docs = Views(spark, sf_dir).table("documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, ("tion", "zzzz", "the ", "und ")))).alias("phrase"))
    return docs.where("NOT contains(text, phrase)").select("doc_id", "phrase")


@query("""SELECT lang AS name, avg(n_chars) AS local_value, CASE lang WHEN 'en' THEN 3000 ELSE 3500 END AS published, avg(n_chars) >= CASE lang WHEN 'en' THEN 3000 ELSE 3500 END AS reached FROM documents GROUP BY lang""")
def mx18_published_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local values beside published ones, and whether they are reached."""
    local = Views(spark, sf_dir).table("documents").groupBy(F.col("lang").alias("name")).agg(F.avg("n_chars").alias("local_value"))
    published = F.when(F.col("name") == "en", 3000).otherwise(3500)
    return local.select("name", "local_value", published.alias("published"), (F.col("local_value") >= published).alias("reached"))


@query("""WITH x AS (SELECT l_orderkey AS entity, l_linestatus AS system, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT entity, n FROM x QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, system) = 1""")
def mx37_first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a name after merging groups: the one with most members."""
    counts = Views(spark, sf_dir).table("lineitem").groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linestatus").alias("system")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "system"))
    return counts.withColumn("r", first).where("r = 1").select("entity", "n")


@query("SELECT page_id, CASE WHEN lang = 'unknown' THEN coalesce(nullif(html_lang, ''), 'unknown') ELSE lang END AS lang FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'en' END AS lang, lower(regexp_extract(html, '<html[^>]*lang=\"([a-zA-Z]+)', 1)) AS html_lang FROM pages)")
def lg04_metadata_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of a page's markup stands in only where none was found."""
    found = F.when(F.col("page_id") % 3 == 0, "unknown").otherwise("en")
    markup = F.nullif(F.lower(F.regexp_extract("html", '<html[^>]*lang="([a-zA-Z]+)', 1)), F.lit(""))
    return Views(spark, sf_dir).table("pages").select("page_id", F.when(found == "unknown", F.coalesce(markup, F.lit("unknown"))).otherwise(found).alias("lang"))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN n_chars < 400 THEN 'rejected' WHEN strpos(text, chr(10)) = 0 THEN 'failed' ELSE 'success' END AS verdict FROM documents) GROUP BY verdict")
def lg09_batch_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a batch: too short texts are rejected, texts of one line count as not extracted."""
    verdict = F.when(F.col("n_chars") < 400, "rejected").when(F.instr("text", "\n") == 0, "failed").otherwise("success")
    return Views(spark, sf_dir).table("documents").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
