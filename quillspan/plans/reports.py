"""Reports: dictionary listings, run summaries, comparisons, crosstabs and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import latest_by
from ..registry import query
from .views import Views


@query("""SELECT s.s_suppkey AS wanted, p.p_partkey AS found, p.p_name FROM supplier s LEFT JOIN part p ON p.p_partkey = (SELECT min(q.p_partkey) FROM part q WHERE q.p_partkey = s.s_suppkey OR q.p_size = s.s_suppkey)""")
def mx01_concept_by_id_or_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first concept whose id or code is the wanted one; two equality joins instead of an OR."""
    v = Views(spark, sf_dir)
    part = v.table("part").select("p_partkey", "p_name", "p_size")
    wanted = v.table("supplier").select(F.col("s_suppkey").alias("wanted"))
    by_id = wanted.join(part, F.col("wanted") == F.col("p_partkey")).select("wanted", "p_partkey", "p_name")
    by_code = wanted.join(part, F.col("wanted") == F.col("p_size")).select("wanted", "p_partkey", "p_name")
    first = latest_by(by_id.unionByName(by_code), ["wanted"], [F.col("p_partkey")])
    return wanted.join(first, "wanted", "left").select("wanted", F.col("p_partkey").alias("found"), "p_name")


@query("SELECT 'part' AS dictionary, p_partkey AS id, coalesce(nullif(p_name, ''), p_type) AS term FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def mx02_dictionary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    part = v.table("part").select(F.lit("part").alias("dictionary"), F.col("p_partkey").alias("id"), F.coalesce(F.nullif("p_name", F.lit("")), "p_type").alias("term"))
    return part.unionByName(v.table("supplier").select(F.lit("supplier").alias("dictionary"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("term")))


@query("""SELECT a.id, a.title, coalesce(r.statuses, []) AS statuses, coalesce(l.labels, 0) AS labels FROM articles a LEFT JOIN (SELECT document_id, list(review_status ORDER BY id) AS statuses FROM reviews GROUP BY ALL) r ON r.document_id = a.id LEFT JOIN (SELECT article_id, count(*) AS labels FROM ai_labels GROUP BY ALL) l ON l.article_id = a.id""")
def mx03_document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    history = v.reviews.groupBy(F.col("document_id").cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "review_status"))).alias("h"))
    history = history.select("id", F.transform("h", lambda x: x["review_status"]).alias("statuses"))
    labels = v.ai_labels.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("labels"))
    out = v.articles.select("id", "title").join(history, "id", "left").join(labels, "id", "left")
    return out.select("id", "title", F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"), F.coalesce("labels", F.lit(0)).alias("labels"))


@query("""SELECT event_type AS system, event_id, user_id, (SELECT count(*) FROM events WHERE value < 5) AS total FROM events WHERE value < 5 ORDER BY event_type, event_id LIMIT 2000""")
def mx04_run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = Views(spark, sf_dir).table("events").where("value < 5").select(F.col("event_type").alias("system"), "event_id", "user_id")
    return errors.orderBy("system", "event_id").limit(2000).join(F.broadcast(errors.agg(F.count(F.lit(1)).alias("total"))))


@query("SELECT article_id, expert_id, count(*) AS sessions FROM assignments GROUP BY ALL")
def mx05_draft_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).assignments.groupBy("article_id", "expert_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT o_orderstatus AS db, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL""")
def mx21_year_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("orders").groupBy(F.col("o_orderstatus").alias("db"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT DISTINCT doc_id, label FROM gold), p AS (SELECT DISTINCT doc_id, label FROM predicted)
SELECT label, count_if(g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count_if(g.doc_id IS NULL) AS fp, count_if(p.doc_id IS NULL) AS fn FROM g FULL JOIN p USING (doc_id, label) GROUP BY label""".replace("g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL", "coalesce(g.x = 1 AND p.x = 1, false)").replace("g.doc_id IS NULL", "g.x IS NULL").replace("p.doc_id IS NULL", "p.x IS NULL").replace("SELECT DISTINCT doc_id, label FROM", "SELECT DISTINCT doc_id, label, 1 AS x FROM"))
def mx22_surface_set_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    side = lambda df, name: df.select("doc_id", "label").distinct().withColumn(name, F.lit(1))
    both = side(v.gold, "g").join(side(v.predicted, "p"), ["doc_id", "label"], "full_outer")
    return both.groupBy("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@query("""SELECT p_partkey, new_name, count(*) OVER (PARTITION BY new_name) > 1 AS conflict FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS new_name FROM part)""")
def mx24_rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Views(spark, sf_dir).table("part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_").alias("new_name"))
    counts = names.groupBy("new_name").agg((F.count(F.lit(1)) > 1).alias("conflict"))
    return names.join(counts, "new_name").select("p_partkey", "new_name", "conflict")


@query("""SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || ' (' || rn || ')' END AS path FROM (SELECT p_partkey, lower(p_name) AS base, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part)""")
def mx25_unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part").select("p_partkey", F.lower("p_name").alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return part.withColumn("rn", n).select("p_partkey", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat(F.col("base"), F.lit(" ("), F.col("rn"), F.lit(")"))).alias("path"))


@query("""WITH f AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents), g AS (SELECT sha, min(doc_id) AS original, min_by(lang, doc_id) AS lang FROM f GROUP BY sha) SELECT f.doc_id, g.original, g.lang AS copied_lang FROM f JOIN g USING (sha) WHERE f.doc_id <> g.original""")
def mx26_duplicate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Views(spark, sf_dir).table("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min(F.struct("doc_id", "lang")).alias("f"))
    return docs.join(first, "sha").where("doc_id <> f.doc_id").select("doc_id", F.col("f.doc_id").alias("original"), F.col("f.lang").alias("copied_lang"))


@query("""SELECT user_id, event_type, value, value / max(value) OVER () AS scaled FROM (SELECT user_id, event_type, sum(value) AS value FROM events GROUP BY ALL)""")
def mx36_scaled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars scaled to the longest; the maximum is an aggregate of its own, not a window over all rows."""
    sums = Views(spark, sf_dir).table("events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return sums.join(F.broadcast(sums.agg(F.max("value").alias("top")))).select("user_id", "event_type", "value", (F.col("value") / F.col("top")).alias("scaled"))


@query("""SELECT DISTINCT t.token, l.key IS NULL AS is_new FROM tokens t LEFT JOIN lexicon l ON l.key = t.token WHERE length(t.token) >= 6""")
def mx38_new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    terms = v.tokens.select("token").where("length(token) >= 6").distinct()
    return terms.join(v.lexicon().select(F.col("key").alias("token"), F.lit(False).alias("known")), "token", "left").select("token", F.col("known").isNull().alias("is_new"))


@query("""SELECT l_returnflag AS label, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS before, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS after,
  sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS delta FROM lineitem GROUP BY ALL""")
def ev13_metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = Views(spark, sf_dir).table("lineitem").groupBy(F.col("l_returnflag").alias("label")).pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return pivoted.select("label", F.col("O").alias("before"), F.col("F").alias("after"), (F.col("F") - F.col("O")).alias("delta"))


@query("""SELECT role, string_agg(turn || ': ' || text, ' | ' ORDER BY turn) AS prompt, conv_id FROM conversations GROUP BY conv_id, role""")
def mx35_prompt_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("turn"), F.lit(": "), "text")
    grouped = Views(spark, sf_dir).table("conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return grouped.select("role", F.array_join(F.transform("l", lambda x: x["line"]), " | ").alias("prompt"), "conv_id")


@query("SELECT event_type, avg(value) AS mean_value, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def ag13_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("events").groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT source, lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1""")
def ag15_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Views(spark, sf_dir).table("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct(F.col("n"), -F.col("first"))).alias("lang"))


@query("""WITH k AS (SELECT system, error, label, count(*) AS n FROM (SELECT l_shipdate > TIMESTAMP '1996-01-01' AS system, l_returnflag AS error, l_linestatus AS label FROM lineitem) GROUP BY ALL) SELECT * FROM k""")
def ag08_nested_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Views(spark, sf_dir).table("lineitem").select((F.col("l_shipdate") > F.to_timestamp(F.lit("1996-01-01 00:00:00"))).alias("system"), F.col("l_returnflag").alias("error"), F.col("l_linestatus").alias("label"))
    return li.groupBy("system", "error", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT line, count(DISTINCT doc_id) AS page_sets FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(DISTINCT doc_id) >= 2""")
def ag16_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several documents; repeats within one go before the shuffle."""
    lines = Views(spark, sf_dir).table("documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    return lines.groupBy("line").agg(F.count_distinct("doc_id").alias("page_sets")).where("page_sets >= 2")
