"""Review workflow analytics: lists, dashboards, latest rows, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import all_of, append_missing, contains_text, keep_known, keep_old, latest_by, page, replace_by_key, upsert
from ..operators.search import containing
from ..registry import query
from .views import Views


@query("SELECT id, surface_form, concept_code FROM aliases WHERE status = 'APPROVED' ORDER BY id")
def q01_approved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).aliases.where("status = 'APPROVED'").select("id", "surface_form", "concept_code").orderBy("id")


@query("SELECT id, title FROM articles WHERE abstract IS NOT NULL AND trim(abstract) <> '' ORDER BY id DESC LIMIT 50")
def q02_newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).articles.where("abstract IS NOT NULL AND trim(abstract) <> ''").orderBy(F.desc("id")).limit(50).select("id", "title")


@query("SELECT article_id, payload, max(id) AS latest_id, count(*) AS copies FROM ai_labels GROUP BY article_id, payload HAVING count(*) > 1")
def q03_payload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).ai_labels.groupBy("article_id", "payload").agg(F.max("id").alias("latest_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""SELECT a.id, a.title, count(DISTINCT CASE WHEN s.status = 'OPEN' THEN s.id END) AS open_sessions
FROM articles a LEFT JOIN assignments x ON x.article_id = a.id LEFT JOIN sessions s ON s.id = x.session_id GROUP BY a.id, a.title""")
def q04_articles_open_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    open_ = v.sessions.where("status = 'OPEN'").select(F.col("id").alias("session_id"))
    counts = v.assignments.join(open_, "session_id").groupBy(F.col("article_id").alias("id")).agg(F.count_distinct("session_id").alias("open_sessions"))
    return v.articles.select("id", "title").join(counts, "id", "left").fillna(0, "open_sessions")


@query("SELECT id, full_name, email FROM users WHERE role = 'expert' AND is_active")
def q05_active_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).users.where("role = 'expert' AND is_active").select("id", "full_name", "email")


@query("""SELECT r.id AS requested_id, u.id IS NULL AS is_missing, coalesce(u.role <> 'expert' OR NOT u.is_active, false) AS is_refused
FROM (SELECT s_suppkey AS id FROM supplier) r LEFT JOIN users u ON u.id = r.id""")
def q06_requested_experts_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    requested = v.table("supplier").select(F.col("s_suppkey").alias("requested_id"))
    users = v.users
    joined = requested.join(users, F.col("requested_id") == users["id"], "left")
    refused = F.coalesce((F.col("role") != "expert") | ~F.col("is_active"), F.lit(False))
    return joined.select("requested_id", F.col("id").isNull().alias("is_missing"), refused.alias("is_refused"))


@query("SELECT DISTINCT x.article_id FROM assignments x JOIN sessions s ON s.id = x.session_id WHERE s.status = 'OPEN'")
def q07_articles_already_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    open_ = v.sessions.where("status = 'OPEN'").select(F.col("id").alias("session_id"))
    return v.assignments.join(open_, "session_id", "left_semi").select("article_id").distinct()


@query("""SELECT s.id, s.name, s.status, coalesce(documents, 0) AS documents, coalesce(experts, 0) AS experts, coalesce(reviewed, 0) AS reviewed, coalesce(adjudicated, 0) AS adjudicated,
  greatest(coalesce(documents, 0) * 2 - coalesce(reviewed, 0), 0) AS remaining
FROM sessions s LEFT JOIN (SELECT session_id, count(DISTINCT article_id) AS documents, count(DISTINCT expert_id) AS experts FROM assignments GROUP BY ALL) x ON x.session_id = s.id
LEFT JOIN (SELECT session_id, count(DISTINCT (document_id, expert_id)) AS reviewed FROM reviews GROUP BY ALL) r ON r.session_id = s.id
LEFT JOIN (SELECT session_id, count(DISTINCT document_id) AS adjudicated FROM adjudications GROUP BY ALL) j ON j.session_id = s.id""")
def q08_session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch is aggregated before it is joined, so rows do not fan out."""
    v = Views(spark, sf_dir)
    assigned = v.assignments.groupBy("session_id").agg(F.count_distinct("article_id").alias("documents"), F.count_distinct("expert_id").alias("experts"))
    reviewed = v.reviews.select("session_id", "document_id", "expert_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("reviewed"))
    adjudicated = v.adjudications.groupBy("session_id").agg(F.count_distinct("document_id").alias("adjudicated"))
    out = v.sessions.withColumnRenamed("id", "session_id")
    for branch in (assigned, reviewed, adjudicated):
        out = out.join(branch, "session_id", "left")
    out = out.fillna(0, ["documents", "experts", "reviewed", "adjudicated"])
    return out.select(F.col("session_id").alias("id"), "name", "status", "documents", "experts", "reviewed", "adjudicated", F.greatest(F.col("documents") * 2 - F.col("reviewed"), F.lit(0)).alias("remaining"))


@query("SELECT id, source_id, status, crawled_at FROM crawl_logs ORDER BY crawled_at DESC, id DESC LIMIT 100")
def q09_newest_crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).crawl_logs.orderBy(F.desc("crawled_at"), F.desc("id")).limit(100).select("id", "source_id", "status", "crawled_at")


@query("""SELECT b.item_id, substring(b.text, 1, 45) AS probe FROM benchmark b
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, substring(b.text, 1, 45))) ORDER BY b.item_id LIMIT 50""")
def q10_reconciliation_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes found in no document: words inside a probe are looked up, so the search is no nested loop."""
    v = Views(spark, sf_dir)
    probes = v.table("benchmark").select("item_id", F.substring("text", 1, 45).alias("probe"))
    found = containing(v.table("documents").select("doc_id", "text"), probes.withColumnRenamed("probe", "passage"), "doc_id", "item_id")
    return probes.join(found.select("item_id").distinct(), "item_id", "left_anti").orderBy("item_id").limit(50)


@query("""SELECT id, surface_form, concept_code, match_method, status, confidence FROM aliases
WHERE status = 'PENDING_REVIEW' AND confidence >= 0.2 AND confidence <= 0.9 ORDER BY id DESC LIMIT 500""")
def q11_alias_filter_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(df: DataFrame, status: str | None = None, method: str | None = None, code: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
        wanted = [(status, F.col("status") == status), (method, F.col("match_method") == method), (code, F.col("concept_code") == code), (low, F.col("confidence") >= low), (high, F.col("confidence") <= high)]
        return df.where(all_of([c for given, c in wanted if given is not None])).orderBy(F.desc("id")).limit(500)

    return listed(Views(spark, sf_dir).aliases, status="PENDING_REVIEW", low=0.2, high=0.9)


@query("""SELECT a.id, a.title, a.year, EXISTS (SELECT 1 FROM ai_labels l WHERE l.article_id = a.id) AS has_ai_label,
  CASE WHEN EXISTS (SELECT 1 FROM reviews r WHERE r.document_id = a.id) THEN 1 ELSE 0 END AS is_labeled
FROM articles a WHERE a.abstract LIKE '%the%'""")
def q12_article_list_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    labelled = v.ai_labels.select(F.col("article_id").alias("id")).distinct().withColumn("has_ai_label", F.lit(True))
    reviewed = v.reviews.select(F.col("document_id").cast("long").alias("id")).distinct().withColumn("is_labeled", F.lit(1))
    out = v.articles.where(contains_text("abstract", "the", wildcards=True)).select("id", "title", "year")
    return out.join(labelled, "id", "left").join(reviewed, "id", "left").fillna({"has_ai_label": False, "is_labeled": 0})


@query("""SELECT o.o_orderkey AS article_id, o.o_orderstatus AS status, count(c.concept_name) AS n_concepts,
  coalesce(list_sort(list(c.concept_name || '/' || c.concept_code) FILTER (c.concept_name IS NOT NULL)), []) AS concepts
FROM orders o LEFT JOIN concepts c ON c.article_id = o.o_orderkey GROUP BY ALL""")
def q13_article_detail_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    grouped = v.concepts.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_concepts"), F.array_sort(F.collect_list(F.concat_ws("/", "concept_name", "concept_code"))).alias("concepts"))
    articles = v.table("orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderstatus").alias("status"))
    out = articles.join(grouped, "article_id", "left")
    return out.select("article_id", "status", F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))


@query("SELECT article_id, max(id) AS id, max_by(payload, id) AS payload, max_by(confidence, id) AS confidence, count(*) AS versions FROM ai_labels GROUP BY article_id")
def q14_latest_ai_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Views(spark, sf_dir).ai_labels
    versions = labels.groupBy("article_id").agg(F.count(F.lit(1)).alias("versions"))
    return latest_by(labels, ["article_id"], [F.desc("id")]).select("article_id", "id", "payload", "confidence").join(versions, "article_id")


@query("SELECT article_id, concept_name AS text, concept_code AS code, 'DICTIONARY' AS source, confidence FROM concepts WHERE concept_code <> '' AND concept_type LIKE 'STANDARD%'")
def q15_document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = Views(spark, sf_dir).concepts.where((F.col("concept_code") != "") & F.col("concept_type").startswith("STANDARD"))
    return concepts.select("article_id", F.col("concept_name").alias("text"), F.col("concept_code").alias("code"), F.lit("DICTIONARY").alias("source"), "confidence")


@query("""SELECT d.doc_id, count(l.id) AS stored, CASE WHEN count(l.id) = 0 THEN len(regexp_extract_all(any_value(d.text), '[\\p{L}\\p{N}_]+')) ELSE count(l.id) END AS n_labels,
  CASE WHEN count(l.id) = 0 THEN 'RECOMPUTED' ELSE 'STORED' END AS origin
FROM documents d LEFT JOIN ai_labels l ON l.article_id = d.doc_id GROUP BY d.doc_id""")
def q16_stored_or_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    stored = v.ai_labels.groupBy(F.col("article_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("stored"))
    out = v.table("documents").select("doc_id", "text").join(stored, "doc_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    fresh = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).cast("long")
    return out.select("doc_id", "stored", F.when(F.col("stored") == 0, fresh).otherwise(F.col("stored")).alias("n_labels"), F.when(F.col("stored") == 0, "RECOMPUTED").otherwise("STORED").alias("origin"))


@query("""SELECT article_id, expert_id, session_id, status FROM (
  SELECT x.*, s.status, row_number() OVER (PARTITION BY x.article_id, x.expert_id ORDER BY (s.status = 'OPEN') DESC, s.id DESC) AS rn
  FROM assignments x JOIN sessions s ON s.id = x.session_id) WHERE rn = 1""")
def q17_preferred_open_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    joined = v.assignments.join(v.sessions.select(F.col("id").alias("session_id"), "status"), "session_id")
    return latest_by(joined, ["article_id", "expert_id"], [F.desc(F.col("status") == "OPEN"), F.desc("session_id")]).select("article_id", "expert_id", "session_id", "status")


@query("""SELECT article_id, reviewer_id, session_id, status FROM (
  SELECT DISTINCT x.article_id, s.reviewer_id, s.id AS session_id, s.status FROM assignments x JOIN sessions s ON s.id = x.session_id)
QUALIFY row_number() OVER (PARTITION BY article_id, reviewer_id ORDER BY (status = 'OPEN') DESC, session_id DESC) = 1""")
def q18_reviewer_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    joined = v.assignments.select("article_id", "session_id").distinct().join(v.sessions.select(F.col("id").alias("session_id"), "status", "reviewer_id"), "session_id")
    return latest_by(joined, ["article_id", "reviewer_id"], [F.desc(F.col("status") == "OPEN"), F.desc("session_id")]).select("article_id", "reviewer_id", "session_id", "status")


@query("""SELECT r.id, r.document_id, u.full_name, r.review_status, r.created_at FROM reviews r JOIN users u ON u.id = r.expert_id WHERE r.session_id = 3""")
def q19_review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    def history(v: Views, expert: int | None = None, session: int | None = None) -> DataFrame:
        wanted = [F.col("expert_id") == expert] * (expert is not None) + [F.col("session_id") == session] * (session is not None)
        users = v.users.select(F.col("id").alias("expert_id"), "full_name")
        return v.reviews.where(all_of(wanted)).join(users, "expert_id").select("id", "document_id", "full_name", "review_status", "created_at")

    return history(Views(spark, sf_dir), session=3)


@query("""SELECT r.document_id, r.session_id, count(DISTINCT r.expert_id) AS experts,
  CASE WHEN count(DISTINCT r.expert_id) < 2 THEN 'PENDING' ELSE coalesce(any_value(j.resolution_status), 'CONFLICT') END AS case_status
FROM reviews r LEFT JOIN (SELECT document_id, session_id, max_by(resolution_status, id) AS resolution_status FROM adjudications GROUP BY ALL) j USING (document_id, session_id)
GROUP BY ALL""")
def q20_case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    experts = v.reviews.groupBy("document_id", "session_id").agg(F.count_distinct("expert_id").alias("experts"))
    decided = v.adjudications.groupBy("document_id", "session_id").agg(F.max_by("resolution_status", "id").alias("resolution"))
    status = F.when(F.col("experts") < 2, "PENDING").otherwise(F.coalesce("resolution", F.lit("CONFLICT")))
    return experts.join(decided, ["document_id", "session_id"], "left").select("document_id", "session_id", "experts", status.alias("case_status"))


@query("""SELECT x.expert_id, count(DISTINCT x.article_id) AS assigned, count(DISTINCT CASE WHEN l.article_id IS NOT NULL THEN x.article_id END) AS with_ai,
  count(DISTINCT CASE WHEN r.document_id IS NOT NULL THEN (x.session_id, x.article_id) END) AS reviewed,
  count(DISTINCT CASE WHEN s.status = 'OPEN' THEN s.id END) AS active_sessions
FROM assignments x LEFT JOIN (SELECT DISTINCT article_id FROM ai_labels) l USING (article_id)
LEFT JOIN (SELECT DISTINCT session_id, document_id, expert_id FROM reviews) r ON r.session_id = x.session_id AND r.document_id = x.article_id AND r.expert_id = x.expert_id
LEFT JOIN sessions s ON s.id = x.session_id GROUP BY x.expert_id""")
def q21_expert_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    labelled = v.ai_labels.select("article_id").distinct().withColumn("ai", F.col("article_id"))
    done = v.reviews.select("session_id", F.col("document_id").cast("long").alias("article_id"), "expert_id").distinct().withColumn("done", F.lit(True))
    joined = v.assignments.join(labelled, "article_id", "left").join(done, ["session_id", "article_id", "expert_id"], "left")
    per = joined.groupBy("expert_id").agg(F.count_distinct("article_id").alias("assigned"), F.count_distinct("ai").alias("with_ai"), F.count_if("done").alias("reviewed"))
    active = v.assignments.select("expert_id", "session_id").distinct().join(v.sessions.where("status = 'OPEN'").select(F.col("id").alias("session_id")), "session_id").groupBy("expert_id").agg(F.count(F.lit(1)).alias("active_sessions"))
    return per.join(active, "expert_id", "left").fillna(0, "active_sessions")


@query("""SELECT x.session_id, x.article_id, x.expert_id FROM assignments x
LEFT JOIN reviews r ON r.session_id = x.session_id AND r.document_id = x.article_id AND r.expert_id = x.expert_id WHERE r.id IS NULL""")
def q24_pending_assignments_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    done = v.reviews.select("session_id", F.col("document_id").cast("long").alias("article_id"), "expert_id")
    return v.assignments.join(done, ["session_id", "article_id", "expert_id"], "left_anti").select("session_id", "article_id", "expert_id")


@query("SELECT count(DISTINCT (session_id, document_id, expert_id)) AS reviewed, count(DISTINCT document_id) AS documents, count(DISTINCT expert_id) AS experts FROM reviews")
def q23_reviewed_multi_column_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).reviews.agg(F.count_distinct("session_id", "document_id", "expert_id").alias("reviewed"), F.count_distinct("document_id").alias("documents"), F.count_distinct("expert_id").alias("experts"))


_LATEST_REVIEW = "(SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY document_id, expert_id ORDER BY id DESC) = 1)"


@query(f"""SELECT a.id, a.title, string_agg(DISTINCT r.review_status, ', ' ORDER BY r.review_status) AS statuses,
  string_agg(DISTINCT lpad(r.expert_id::VARCHAR, 4, '0'), '; ' ORDER BY lpad(r.expert_id::VARCHAR, 4, '0')) AS experts, max(r.id) AS latest_review
FROM articles a JOIN {_LATEST_REVIEW} r ON r.document_id = a.id GROUP BY a.id, a.title""")
def q26_icd_doc_list_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    latest = latest_by(v.reviews, ["document_id", "expert_id"], [F.desc("id")])
    named = latest.withColumn("expert", F.lpad(F.col("expert_id").cast("string"), 4, "0"))
    lists = named.groupBy(F.col("document_id").cast("long").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set("review_status")), ", ").alias("statuses"),
        F.array_join(F.array_sort(F.collect_set("expert")), "; ").alias("experts"),
        F.max("id").alias("latest_review"),
    )
    return v.articles.select("id", "title").join(lists, "id")


@query("""SELECT a.id, l.payload, l.confidence, r.review_status, r.expert_id FROM articles a
JOIN (SELECT * FROM ai_labels QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY id DESC) = 1) l ON l.article_id = a.id
LEFT JOIN (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id DESC) = 1) r ON r.document_id = a.id""")
def q27_ai_doc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    label = latest_by(v.ai_labels, ["article_id"], [F.desc("id")]).select(F.col("article_id").alias("id"), "payload", "confidence")
    review = latest_by(v.reviews, ["document_id"], [F.desc("id")]).select(F.col("document_id").cast("long").alias("id"), "review_status", "expert_id")
    return v.articles.select("id").join(label, "id").join(review, "id", "left")


@query(f"SELECT id, document_id, expert_id, review_status FROM {_LATEST_REVIEW}")
def q28_latest_review_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(Views(spark, sf_dir).reviews, ["document_id", "expert_id"], [F.desc("id")]).select("id", "document_id", "expert_id", "review_status")


@query("""SELECT r.id, a.title, u.full_name FROM reviews r JOIN articles a ON a.id = r.document_id JOIN users u ON u.id = r.expert_id
WHERE contains(a.title, 'en') OR contains(u.full_name, '12')""")
def q29_reviews_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    articles, users = v.articles.select(F.col("id").alias("article_id"), "title"), v.users.select(F.col("id").alias("user_id"), "full_name")
    joined = v.reviews.join(articles, F.col("document_id") == F.col("article_id")).join(users, F.col("expert_id") == F.col("user_id"))
    return joined.where(contains_text("title", "en") | contains_text("full_name", "12")).select("id", "title", "full_name")


@query("""SELECT s.reviewer_id, count(DISTINCT x.article_id) * 2 AS expected, (SELECT count(*) FROM reviews r WHERE r.session_id IN (SELECT id FROM sessions t WHERE t.reviewer_id = s.reviewer_id)) AS reviews,
  greatest(0, count(DISTINCT x.article_id) * 2 - (SELECT count(*) FROM reviews r WHERE r.session_id IN (SELECT id FROM sessions t WHERE t.reviewer_id = s.reviewer_id))) AS pending
FROM sessions s JOIN assignments x ON x.session_id = s.id GROUP BY s.reviewer_id""")
def q30_reviewer_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    sessions = v.sessions.select(F.col("id").alias("session_id"), "reviewer_id")
    expected = v.assignments.join(sessions, "session_id").groupBy("reviewer_id").agg((F.count_distinct("article_id") * 2).alias("expected"))
    made = v.reviews.groupBy("session_id").count().join(sessions, "session_id").groupBy("reviewer_id").agg(F.sum("count").alias("reviews"))
    out = expected.join(made, "reviewer_id", "left").fillna(0, "reviews")
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("expected") - F.col("reviews")))


@query("""SELECT r.session_id, r.document_id, count(DISTINCT r.expert_id) AS experts,
  CASE WHEN count(DISTINCT r.expert_id) < 2 THEN 'WAITING' WHEN bool_or(r.review_status = 'error') THEN 'REWORK' WHEN any_value(j.resolution_status) IS NOT NULL THEN 'DONE' ELSE 'READY' END AS case_status,
  string_agg(DISTINCT r.review_status, ',' ORDER BY r.review_status) AS statuses
FROM (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY session_id, document_id, expert_id ORDER BY id DESC) = 1) r
LEFT JOIN (SELECT * FROM adjudications QUALIFY row_number() OVER (PARTITION BY session_id, document_id ORDER BY id DESC) = 1) j USING (session_id, document_id) GROUP BY ALL""")
def q31_reviewer_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    latest = latest_by(v.reviews, ["session_id", "document_id", "expert_id"], [F.desc("id")])
    cases = latest.groupBy("session_id", "document_id").agg(F.count_distinct("expert_id").alias("experts"), F.bool_or(F.col("review_status") == "error").alias("failed"), F.array_join(F.array_sort(F.collect_set("review_status")), ",").alias("statuses"))
    decided = latest_by(v.adjudications, ["session_id", "document_id"], [F.desc("id")]).select("session_id", "document_id", "resolution_status")
    status = F.when(F.col("experts") < 2, "WAITING").when(F.col("failed"), "REWORK").when(F.col("resolution_status").isNotNull(), "DONE").otherwise("READY")
    return cases.join(decided, ["session_id", "document_id"], "left").select("session_id", "document_id", "experts", status.alias("case_status"), "statuses")


@query("""WITH latest AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY session_id, document_id, expert_id ORDER BY id DESC) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, document_id ORDER BY id DESC) AS rn FROM latest)
SELECT session_id, document_id, max(CASE WHEN rn = 1 THEN id END) AS review_a, max(CASE WHEN rn = 2 THEN id END) AS review_b FROM ranked WHERE rn <= 2 GROUP BY ALL HAVING count(*) = 2""")
def q32_two_latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest reviews of a case by different experts; a case with one expert is not eligible."""
    latest = latest_by(Views(spark, sf_dir).reviews, ["session_id", "document_id", "expert_id"], [F.desc("id")])
    two = latest_by(latest, ["session_id", "document_id"], [F.desc("id")], n=2)
    return two.groupBy("session_id", "document_id").agg(F.max("id").alias("review_a"), F.min("id").alias("review_b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("SELECT document_id, max(id) AS id, max_by(resolution_status, id) AS resolution_status, max_by(reviewer_id, id) AS reviewer_id FROM adjudications GROUP BY document_id")
def q33_latest_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(Views(spark, sf_dir).adjudications, ["document_id"], [F.desc("id")]).select("document_id", "id", "resolution_status", "reviewer_id")


@query("SELECT u.id, u.full_name, lower(u.role) AS role, count(r.id) AS reviews FROM users u LEFT JOIN reviews r ON r.expert_id = u.id GROUP BY ALL")
def q34_user_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    counts = v.reviews.groupBy(F.col("expert_id").alias("id")).agg(F.count(F.lit(1)).alias("reviews"))
    return v.users.select("id", "full_name", F.lower("role").alias("role")).join(counts, "id", "left").fillna(0, "reviews")


@query("SELECT concept_name, concept_code, count(*) AS frequency FROM concepts WHERE concept_type LIKE 'PROMO%' OR true GROUP BY ALL ORDER BY frequency DESC, concept_name, concept_code LIMIT 20")
def q35_top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions are counted by part before the names are joined, so the large side shrinks first."""
    v = Views(spark, sf_dir)
    counts = v.table("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    part = v.table("part").select("p_partkey", F.col("p_name").alias("concept_name"), F.col("p_brand").alias("concept_code"))
    named = counts.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("concept_name", "concept_code").agg(F.sum("n").alias("frequency"))
    return named.orderBy(F.desc("frequency"), "concept_name", "concept_code").limit(20)


@query("""WITH flags AS (SELECT a.id, EXISTS (SELECT 1 FROM reviews r WHERE r.document_id = a.id AND r.review_status = 'click') AS ner, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id) AS ai FROM articles a)
SELECT count_if(ner AND ai) AS both_sources, count_if(ner AND NOT ai) AS ner_only, count_if(ai AND NOT ner) AS ai_only, count_if(NOT ner AND NOT ai) AS no_label FROM flags""")
def q36_label_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    ner = v.reviews.where("review_status = 'click'").select(F.col("document_id").cast("long").alias("id")).distinct().withColumn("ner", F.lit(True))
    ai = v.table("labels").select(F.col("doc_id").alias("id")).distinct().withColumn("ai", F.lit(True))
    flags = v.table("documents").select(F.col("doc_id").alias("id")).join(ner, "id", "left").join(ai, "id", "left").fillna(False, ["ner", "ai"])
    return flags.agg(F.count_if(F.expr("ner AND ai")).alias("both_sources"), F.count_if(F.expr("ner AND NOT ai")).alias("ner_only"), F.count_if(F.expr("ai AND NOT ner")).alias("ai_only"), F.count_if(F.expr("NOT ner AND NOT ai")).alias("no_label"))


@query("SELECT document_id FROM reviews GROUP BY document_id HAVING sum(CASE WHEN review_status = 'signup' AND session_id = 1 THEN 1 ELSE 0 END) = 0 ORDER BY document_id LIMIT 10")
def q37_coverage_having_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = Views(spark, sf_dir).reviews.groupBy("document_id").agg(F.count_if(F.expr("review_status = 'signup' AND session_id = 1")).alias("n"))
    return per.where("n = 0").select("document_id").orderBy("document_id").limit(10)


@query("""SELECT DISTINCT l.article_id, EXISTS (SELECT 1 FROM reviews r WHERE r.document_id = l.article_id AND r.review_status = 'signup') AS reviewed_too FROM ai_labels l""")
def q38_ai_only_and_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    reviewed = v.reviews.where("review_status = 'signup'").select(F.col("document_id").cast("long").alias("article_id"))
    ai = v.ai_labels.select("article_id").distinct()
    both = ai.join(reviewed, "article_id", "left_semi").withColumn("reviewed_too", F.lit(True))
    return both.unionByName(ai.join(reviewed, "article_id", "left_anti").withColumn("reviewed_too", F.lit(False)))


@query("""SELECT e.event_id AS session_token, u.id AS user_id, u.role FROM events e JOIN users u ON u.id = e.user_id
WHERE u.is_active AND e.event_type <> 'error' AND e.ts + INTERVAL 12 HOUR > TIMESTAMP '2024-01-20 00:00:00' AND e.ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def q39_session_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions alive at one moment: not revoked, not expired, of an active user."""
    v = Views(spark, sf_dir)
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    alive = v.table("events").where((F.col("event_type") != "error") & (F.col("ts") > now - F.expr("INTERVAL 12 HOURS")) & (F.col("ts") <= now))
    users = v.users.where("is_active").select(F.col("id").alias("user_id"), "role")
    return alive.join(users, "user_id").select(F.col("event_id").alias("session_token"), "user_id", "role")


@query("SELECT source_id, max(id) AS id, max_by(crawled_at, id) AS crawled_at FROM crawl_logs WHERE status = 'P' GROUP BY source_id")
def q40_resume_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(Views(spark, sf_dir).crawl_logs.where("status = 'P'"), ["source_id"], [F.desc("id")]).select("source_id", "id", "crawled_at")


@query("""SELECT p.page_id, p.url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.lang = 'en')
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id AND l.quality = 0)""")
def q41_crawl_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages neither crawled already nor rejected before."""
    v = Views(spark, sf_dir)
    crawled = v.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    rejected = v.table("labels").where("quality = 0").select(F.col("doc_id").alias("page_id"))
    return v.table("pages").select("page_id", "url").join(crawled, "page_id", "left_anti").join(rejected, "page_id", "left_anti")


@query("SELECT DISTINCT sha256(lower(text)) AS fingerprint FROM conversations")
def q42_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("conversations").select(F.sha2(F.lower("text"), 256).alias("fingerprint")).distinct()


@query("""SELECT expert_id, document_id, max_by(id, (created_at, id)) AS id, max(created_at) AS created_at FROM reviews GROUP BY ALL""")
def q43_latest_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(Views(spark, sf_dir).reviews, ["expert_id", "document_id"], [F.desc("created_at"), F.desc("id")]).select("expert_id", "document_id", "id", "created_at")


@query("""SELECT a.year, a.lang, CASE WHEN p.page_id IS NULL THEN 'missing' WHEN length(p.html) < length(a.abstract) THEN 'short' ELSE 'ok' END AS kind, count(*) AS n
FROM articles a LEFT JOIN pages p ON p.page_id = a.id GROUP BY ALL""")
def q44_storage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    pages = v.table("pages").select(F.col("page_id").alias("id"), F.length("html").alias("stored"))
    sized = v.articles.select("id", "year", "lang", F.length("abstract").alias("expected")).join(pages, "id", "left")
    kind = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") < F.col("expected"), "short").otherwise("ok")
    return sized.groupBy("year", "lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, title, (SELECT count(*) FROM articles WHERE lang = 'en') AS total FROM articles WHERE lang = 'en' ORDER BY id LIMIT 20 OFFSET 40")
def tk02_page_slice_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(Views(spark, sf_dir).articles.where("lang = 'en'").select("id", "title"), [F.col("id")], 3, 20)


@query("SELECT s.session_id, s.article_id, r.r_regionkey AS expert_id FROM (SELECT DISTINCT session_id, article_id FROM assignments) s CROSS JOIN region r")
def snk09_assignment_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of a session for every expert of a panel: the product is what is stored."""
    v = Views(spark, sf_dir)
    panel = v.table("region").select(F.col("r_regionkey").alias("expert_id"))
    return v.assignments.select("session_id", "article_id").distinct().join(panel)


@query("""WITH u AS (SELECT id AS article_id, max(id) AS version FROM articles WHERE lang <> 'en' GROUP BY id)
SELECT coalesce(o.article_id, n.article_id) AS article_id, CASE WHEN n.article_id IS NULL THEN o.status ELSE 'UPDATED' END AS status, coalesce(CASE WHEN n.version % 2 = 0 THEN n.version END, o.version) AS version
FROM (SELECT id AS article_id, 'STORED' AS status, -id AS version FROM articles WHERE lang IN ('en', 'fr')) o FULL JOIN u n USING (article_id)""")
def snk05_upsert_language_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version is taken unless it is null; the status always."""
    articles = Views(spark, sf_dir).articles
    stored = articles.where("lang IN ('en', 'fr')").select(F.col("id").alias("article_id"), F.lit("STORED").alias("status"), (-F.col("id")).alias("version"))
    updates = articles.where("lang <> 'en'").select(F.col("id").alias("article_id"), F.lit("UPDATED").alias("status"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("version"))
    return upsert(stored, updates, ["article_id"], [F.desc("version")], {"version": keep_known})


@query("""WITH fresh AS (SELECT concept_code, count(*) AS occurrences FROM concepts GROUP BY ALL)
SELECT a.surface_form, a.concept_code, a.status, coalesce(f.occurrences, 0) AS occurrences FROM (SELECT DISTINCT ON (surface_form, concept_code) * FROM aliases ORDER BY surface_form, concept_code, id) a LEFT JOIN fresh f USING (concept_code)""")
def snk03_upsert_alias_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery updates the metrics of known aliases and never their status."""
    v = Views(spark, sf_dir)
    known = latest_by(v.aliases, ["surface_form", "concept_code"], [F.col("id")]).select("surface_form", "concept_code", "status", F.lit(0).cast("long").alias("occurrences"))
    counts = v.concepts.groupBy("concept_code").agg(F.count(F.lit(1)).alias("occurrences"))
    updates = known.select("surface_form", "concept_code").join(counts, "concept_code").withColumn("status", F.lit("PENDING_REVIEW"))
    return upsert(known, updates, ["surface_form", "concept_code"], [F.desc("occurrences")], {"status": keep_old})


@query("""SELECT article_id, payload FROM (SELECT DISTINCT article_id, payload FROM ai_labels WHERE created_at >= TIMESTAMP '2024-01-15') n
WHERE NOT EXISTS (SELECT 1 FROM ai_labels o WHERE o.created_at < TIMESTAMP '2024-01-15' AND o.article_id = n.article_id AND o.payload = n.payload)""")
def snk08_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Views(spark, sf_dir).ai_labels
    keyed = labels.withColumn("digest", F.sha2("payload", 256))
    return append_missing(keyed.where("created_at < TIMESTAMP '2024-01-15'"), keyed.where("created_at >= TIMESTAMP '2024-01-15'"), ["article_id", "digest"]).select("article_id", "payload")


@query("""SELECT article_id, concept_name FROM concepts WHERE article_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 'fresh' FROM orders WHERE o_orderstatus = 'P'""")
def snk02_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    stored = v.concepts.select("article_id", "concept_name")
    fresh = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("article_id"), F.lit("fresh").alias("concept_name"))
    return replace_by_key(stored, fresh, ["article_id"])


@query("SELECT event_type, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 6")
def ag18_frequency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Views(spark, sf_dir).table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "event_type").limit(6)


@query("""SELECT id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS attempts,
  count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) > 5 AS blocked
FROM (SELECT event_id AS id, user_id, ts, epoch(ts)::BIGINT AS s FROM events WHERE event_type = 'error')""")
def login_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a user in the last 900 seconds, of times rounded to seconds as in the SQL; over 5 block."""
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    failed = Views(spark, sf_dir).table("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "ts", seconds.alias("s"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-900, 0)
    return failed.withColumn("attempts", F.count(F.lit(1)).over(w)).withColumn("blocked", F.col("attempts") > 5).drop("s")


@query("""SELECT id, title, year FROM articles UNION ALL SELECT 1000000 + l_orderkey, 'new ' || l_linenumber, 2026 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)""")
def snk01_appended_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored articles and those a crawl adds: rows are appended as they are."""
    v = Views(spark, sf_dir)
    new = v.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber").distinct()
    new = new.select((F.col("l_orderkey") + 1_000_000).alias("id"), F.concat(F.lit("new "), F.col("l_linenumber").cast("string")).alias("title"), F.lit(2026).alias("year"))
    return v.articles.select("id", "title", "year").unionByName(new)


@query("""SELECT id, document_id, expert_id, 'review' AS kind FROM reviews UNION ALL SELECT id, document_id, reviewer_id, 'adjudication' FROM adjudications""")
def snk07_append_only_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and adjudications as one log to which rows are only added."""
    v = Views(spark, sf_dir)
    reviews = v.reviews.select("id", "document_id", "expert_id", F.lit("review").alias("kind"))
    return reviews.unionByName(v.adjudications.select("id", "document_id", F.col("reviewer_id").alias("expert_id"), F.lit("adjudication").alias("kind")))
