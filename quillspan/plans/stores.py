"""Stores, names, counts and checks: the smaller operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import runs_of
from ..operators.alignment import hits
from ..operators.layout import numbering_depth
from ..operators.relational import keep_old, latest_by, upsert
from ..registry import query
from ..sources import readers, writers
from .views import Views


@query("""SELECT expert_id, count(DISTINCT article_id) AS with_ai FROM assignments x WHERE EXISTS (SELECT 1 FROM ai_labels l WHERE l.article_id = x.article_id) GROUP BY expert_id""")
def q22_expert_ai_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned articles that have a model's label, by expert."""
    v = Views(spark, sf_dir)
    labelled = v.ai_labels.select("article_id").distinct()
    return v.assignments.join(labelled, "article_id", "left_semi").groupBy("expert_id").agg(F.count_distinct("article_id").alias("with_ai"))


@query("""SELECT expert_id, count(DISTINCT session_id) AS active FROM assignments x WHERE session_id IN (SELECT id FROM sessions WHERE status = 'OPEN') GROUP BY expert_id""")
def q25_expert_active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    open_ = v.sessions.where("status = 'OPEN'").select(F.col("id").alias("session_id"))
    return v.assignments.join(open_, "session_id", "left_semi").groupBy("expert_id").agg(F.count_distinct("session_id").alias("active"))


@query("""SELECT s.source, l.label, count(d.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT unnest(['en', 'fr', 'de', 'es', 'vi']) AS label) l LEFT JOIN documents d ON d.source = s.source AND d.lang = l.label GROUP BY ALL""")
def ag07_zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and label, with zeros for labels that a source lacks: the labels are a literal list."""
    docs = Views(spark, sf_dir).table("documents").groupBy("source", F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = docs.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("en", "fr", "de", "es", "vi")))).alias("label"))
    return grid.join(docs, ["source", "label"], "left").fillna(0, ["n"])


@query(r"""WITH w AS MATERIALIZED (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents), u AS MATERIALIZED (SELECT token, count(*)::DOUBLE AS c FROM (SELECT unnest(a) AS token FROM w) GROUP BY token),
b AS MATERIALIZED (SELECT x, y, count(*)::DOUBLE AS n FROM (SELECT unnest(a[1:len(a) - 1]) AS x, unnest(a[2:]) AS y FROM w WHERE len(a) > 1) GROUP BY ALL),
p AS (SELECT x, y, log2(n * (SELECT sum(c) FROM u) / (u.c * v.c)) AS pmi FROM b JOIN u ON u.token = x JOIN u v ON v.token = y),
t AS (SELECT DISTINCT x, y, z FROM (SELECT unnest(a[1:len(a) - 2]) AS x, unnest(a[2:len(a) - 1]) AS y, unnest(a[3:]) AS z FROM w WHERE len(a) > 2))
SELECT t.x || ' ' || t.y || ' ' || t.z AS phrase, round((p.pmi + q.pmi) / 2, 5) AS mean_pmi FROM t JOIN p ON p.x = t.x AND p.y = t.y JOIN (SELECT x AS y, y AS z, pmi FROM p) q ON q.y = t.y AND q.z = t.z""")
def ag11_mean_phrase_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pointwise mutual information over the neighbours of each distinct phrase of three words."""
    words = Views(spark, sf_dir).table("documents").select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("t"))
    single = words.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("c"))
    shifted = F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1)))
    pairs = words.select(F.explode(F.zip_with("t", shifted, lambda a, b: F.struct(a.alias("x"), b.alias("y")))).alias("p")).select("p.*").where("y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = single.agg(F.sum("c").alias("total"))
    pmi = pairs.join(single.select(F.col("token").alias("x"), F.col("c").alias("cx")), "x").join(single.select(F.col("token").alias("y"), F.col("c").alias("cy")), "y").join(F.broadcast(total))
    pmi = pmi.select("x", "y", F.log2(F.col("n") * F.col("total") / (F.col("cx") * F.col("cy"))).alias("pmi"))
    phrases = words.select(F.explode(runs_of(F.col("t"), 3)).alias("phrase")).distinct()
    parts = F.split("phrase", " ")
    phrases = phrases.select("phrase", parts[0].alias("x"), parts[1].alias("y"), parts[2].alias("z"))
    later = pmi.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("pmi").alias("pmi2"))
    return phrases.join(pmi, ["x", "y"]).join(later, ["y", "z"]).select("phrase", F.round((F.col("pmi") + F.col("pmi2")) / 2, 5).alias("mean_pmi"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS surface, p_brand AS code, 'PENDING' AS status FROM part WHERE p_partkey % 3 > 0), u AS (SELECT p_partkey AS id, upper(p_name) AS surface, p_type AS code, 'APPROVED' AS status FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(u.id, t.id) AS id, CASE WHEN u.id IS NULL THEN t.surface ELSE u.surface END AS surface, CASE WHEN u.id IS NULL THEN t.code ELSE u.code END AS code, CASE WHEN u.id IS NULL THEN t.status ELSE u.status END AS status FROM t FULL JOIN u ON t.id = u.id""")
def snk04_alias_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval by hand overwrites everything, the status too."""
    part = Views(spark, sf_dir).table("part")
    row = lambda df, name, code, status: df.select(F.col("p_partkey").alias("id"), name.alias("surface"), F.col(code).alias("code"), F.lit(status).alias("status"))
    stored = row(part.where("p_partkey % 3 > 0"), F.col("p_name"), "p_brand", "PENDING")
    return upsert(stored, row(part.where("p_partkey % 2 = 0"), F.upper("p_name"), "p_type", "APPROVED"), ["id"], [F.asc("surface")])


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS title, 'f' || p_size AS fingerprint FROM part WHERE p_partkey % 3 > 0), u AS (SELECT p_partkey AS id, upper(p_name) AS title, 'g' || p_size AS fingerprint FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(u.id, t.id) AS id, coalesce(u.title, t.title) AS title, coalesce(t.fingerprint, u.fingerprint) AS fingerprint FROM t FULL JOIN u ON t.id = u.id""")
def snk06_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New metadata counts, but a stored fingerprint stays."""
    part = Views(spark, sf_dir).table("part")
    row = lambda df, name, mark: df.select(F.col("p_partkey").alias("id"), name.alias("title"), F.concat(F.lit(mark), F.col("p_size").cast("string")).alias("fingerprint"))
    return upsert(row(part.where("p_partkey % 3 > 0"), F.col("p_name"), "f"), row(part.where("p_partkey % 2 = 0"), F.upper("p_name"), "g"), ["id"], [F.asc("title")], {"fingerprint": keep_old})


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS stem FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def snk17_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.unique_names(Views(spark, sf_dir).table("part"), "p_name", F.asc("p_partkey")).select("p_partkey", "stem")


@query("SELECT p_partkey, printf('%s_%06d', p_brand, n + coalesce(h, 0)) AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey >= 50) LEFT JOIN (SELECT p_brand, max(p_size)::BIGINT AS h FROM part WHERE p_partkey < 50 GROUP BY p_brand) USING (p_brand)")
def snk18_sequence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part")
    old = part.where("p_partkey < 50").select("p_brand", F.col("p_size").cast("long").alias("n"))
    return writers.sequence_names(part.where("p_partkey >= 50"), "p_brand", F.asc("p_partkey"), old).select("p_partkey", "name")


@query("""SELECT p_partkey, CASE WHEN p_name || '.pdf' IN (SELECT p_name || '.pdf' FROM part WHERE p_partkey < 15) THEN p_name || '_' || substring(sha256(p_type), 1, 10) || '.pdf' ELSE p_name || '.pdf' END AS target FROM part WHERE p_partkey >= 15""")
def snk19_collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose name the target folder has gets a part of its hash."""
    files = Views(spark, sf_dir).table("part").withColumn("name", F.concat("p_name", F.lit(".pdf")))
    return writers.collision_names(files.where("p_partkey >= 15"), "name", F.sha2("p_type", 256), files.where("p_partkey < 15")).select("p_partkey", "target")


@query(r"""SELECT conv_id, turn, nullif(regexp_extract(answer, '(?s)(\{.*\})', 1), '') AS body, json_extract_string(nullif(regexp_extract(answer, '(?s)(\{.*\})', 1), ''), '$.n') AS n FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '```json' || chr(10) || '{"n": ' || turn || '}' || chr(10) || '```' WHEN 1 THEN 'so: {"n": "' || role || '"} ok' ELSE role END AS answer FROM conversations)""")
def fn21_salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON inside a model's answer, fenced or between words."""
    t = F.col("turn")
    answer = F.when(t % 3 == 0, F.concat(F.lit('```json\n{"n": '), t.cast("string"), F.lit("}\n```"))).when(t % 3 == 1, F.concat(F.lit('so: {"n": "'), F.col("role"), F.lit('"} ok'))).otherwise(F.col("role"))
    body = text.salvaged_json(answer)
    return Views(spark, sf_dir).table("conversations").select("conv_id", "turn", body.alias("body"), F.get_json_object(body, "$.n").alias("n"))


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS expires_at, ts + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-05 00:00:00' AS expired, ts::DATE AS day FROM events")
def fn35_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a session token ends, and whether it has by a given moment."""
    ends = F.col("ts") + F.expr("INTERVAL 8 HOURS")
    return Views(spark, sf_dir).table("events").select("event_id", ends.alias("expires_at"), (ends <= F.to_timestamp(F.lit("2024-01-05 00:00:00"))).alias("expired"), F.to_date("ts").alias("day"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 100")
def tk04_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates by priority, then by surface: a report's top list."""
    return Views(spark, sf_dir).table("part").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(100).select("p_partkey", "p_name", "p_size")


@query("""WITH h AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS r FROM (SELECT doc_id, unnest(list_filter(range(length(text)), lambda i: text[i + 1:i + 4] = 'tion')) AS s FROM documents)), m AS (SELECT doc_id, unnest(range(4)) AS r FROM documents)
SELECT doc_id, r::INT AS r, s::INT AS s FROM m LEFT JOIN h USING (doc_id, r)""")
def wn09_nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one surface take its hits by rank; without a hit left they have no place."""
    docs = Views(spark, sf_dir).table("documents").select("doc_id", hits(F.col("text"), F.lit("tion")).alias("h"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"), "h").select("doc_id", "r", F.get("h", F.col("r")).alias("s"))


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS value FROM events) SELECT user_id, count(*) AS expected, count(value) AS have, list_sort(list(event_id) FILTER (value IS NULL)) AS missing FROM p GROUP BY user_id""")
def mx20_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected ids without a prediction, by run: what a retry asks for again."""
    rows = Views(spark, sf_dir).table("events").select("user_id", "event_id", F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("value"))
    missing = F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("event_id"))))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"), F.count("value").alias("have"), F.when(F.size(missing) > 0, missing).alias("missing"))


@query("""WITH g AS (SELECT DISTINCT doc_id, label, token AS surface FROM gold g JOIN tokens t ON t.doc_id = g.doc_id AND t.pos = g.s), p AS (SELECT DISTINCT doc_id, label, token AS surface FROM predicted p JOIN tokens t ON t.doc_id = p.doc_id AND t.pos = p.s)
SELECT label, count(g.d) FILTER (p.d IS NOT NULL) AS tp, count(p.d) FILTER (g.d IS NULL) AS fp, count(g.d) FILTER (p.d IS NULL) AS fn FROM (SELECT *, doc_id AS d FROM g) g FULL JOIN (SELECT *, doc_id AS d FROM p) p USING (doc_id, label, surface) GROUP BY label""".replace("SELECT DISTINCT doc_id, label, token AS surface FROM gold g", "SELECT DISTINCT g.doc_id, label, token AS surface FROM gold g").replace("SELECT DISTINCT doc_id, label, token AS surface FROM predicted p", "SELECT DISTINCT p.doc_id, label, token AS surface FROM predicted p"))
def mx22_surface_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of (document, label, surface) of both sides, counted by label."""
    v = Views(spark, sf_dir)
    words = v.tokens.select("doc_id", F.col("pos").alias("s"), F.col("token").alias("surface"))
    side = lambda df, name: df.join(words, ["doc_id", "s"]).select("doc_id", "label", "surface").distinct().withColumn(name, F.lit(True))
    both = side(v.gold, "g").join(side(v.predicted, "p"), ["doc_id", "label", "surface"], "full_outer")
    return both.groupBy("label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, l_linenumber AS page, l_partkey AS block FROM lineitem) SELECT doc_id, CASE label WHEN 'A' THEN 'abstract' WHEN 'N' THEN 'methods' ELSE 'results' END AS label, min(page) AS first_page, max(page) AS last_page, count(*) AS blocks FROM s GROUP BY ALL""")
def mx28_section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's sections under their canonical labels, with the pages they span."""
    label = F.when(F.col("l_returnflag") == "A", "abstract").when(F.col("l_returnflag") == "N", "methods").otherwise("results")
    rows = Views(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("doc_id"), label.alias("label"), F.col("l_linenumber").alias("page"))
    return rows.groupBy("doc_id", "label").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("blocks"))


@query(r"""SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^\s*[0-9]+([.][0-9]+)*[.]?\s+') THEN len(string_split(regexp_extract(line, '^\s*([0-9]+([.][0-9]+)*)', 1), '.')) WHEN regexp_matches(line, '(?i)^\s*[ivxlcdm]+[.]?\s+') THEN 1 END AS depth
FROM (SELECT doc_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))""")
def mx29_numbering_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep a line's numbering is; null without one."""
    lines = Views(spark, sf_dir).table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", numbering_depth(F.col("line")).alias("depth"))


_NOISE = ("small", "red")


@query("""WITH r AS (SELECT p_brand AS file, p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN '650' || lpad(p_partkey::VARCHAR, 4, '0') ELSE 'x' END AS code, p_name AS cell FROM part),
g AS (SELECT *, last_value(CASE WHEN code LIKE '650%' THEN code END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM r),
w AS (SELECT file, grp, ord, trim(regexp_replace(regexp_replace(cell, '\\b(small|red)\\b', '', 'g'), '\\s+', ' ', 'g')) AS cell FROM g WHERE grp IS NOT NULL)
SELECT file, grp, string_agg(cell, ' ' ORDER BY ord) FILTER (cell <> '') AS merged FROM w GROUP BY file, grp""".replace("\\\\", "\\"))
def src08_merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows merged under the code at or above them, without noise words."""
    code = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("650"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))).otherwise("x")
    rows = Views(spark, sf_dir).table("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), code.alias("code"), F.col("p_name").alias("cell"))
    grouped = readers.code_groups(rows, "ord", "code").withColumnRenamed("group", "grp")
    cell = text.collapse_space(F.regexp_replace("cell", rf"\b({'|'.join(_NOISE)})\b", ""))
    cells = grouped.select("file", "grp", "ord", F.nullif(cell, F.lit("")).alias("cell"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("ord", "cell")))), lambda x: x["cell"]), " ")
    return cells.groupBy("file", "grp").agg(F.nullif(merged, F.lit("")).alias("merged"))


@query("""SELECT split, count(*) AS n, count_if(split = 'test') AS violations FROM splits WHERE doc_id % 3 = 0 GROUP BY split""")
def ds06_split_discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a tuning run by split; rows of the frozen test split are violations."""
    rows = Views(spark, sf_dir).splits.where("doc_id % 3 = 0")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("violations"))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, 'b' || l_partkey AS body, l_returnflag = 'R' AS head FROM lineitem),
h AS (SELECT doc_id, ord AS first, coalesce(lead(ord) OVER (PARTITION BY doc_id ORDER BY ord), 1000000) AS stop FROM b WHERE head)
SELECT h.doc_id, first, string_agg(b.body, ' ' ORDER BY b.ord) AS content FROM h LEFT JOIN b ON b.doc_id = h.doc_id AND b.ord > h.first AND b.ord < h.stop GROUP BY h.doc_id, first""")
def pd15_sections_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections put together from blocks: each block belongs to the last boundary before it."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = Views(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("head"))
    blocks = lines.withColumn("ord", F.row_number().over(order)).select("doc_id", "ord", F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("body"), "head")
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("first", F.last(F.when(F.col("head"), F.col("ord")), ignorenulls=True).over(upto)).where("first IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("ord", "body")))), lambda x: x["body"]), " ")
    return placed.groupBy("doc_id", F.col("first").cast("long").alias("first")).agg(F.nullif(body, F.lit("")).alias("content"))


@query("""SELECT code, arg_min(name, ord) AS name, count(*) AS copies FROM (SELECT p_brand || ':' || p_name AS code, p_type AS name, p_partkey AS ord FROM part) GROUP BY code""")
def src06_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy records: of equal keys the first line stays."""
    rows = Views(spark, sf_dir).table("part").select(F.concat_ws(":", "p_brand", "p_name").alias("code"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ord"))
    copies = rows.groupBy("code").agg(F.count(F.lit(1)).alias("copies"))
    return latest_by(rows, ["code"], [F.asc("ord")]).join(copies, "code").select("code", "name", "copies")
