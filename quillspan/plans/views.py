"""The workflow tables that the queries run on, as views over the stored tables.

Articles, reviews, sessions, assignments and so on stand on documents, events and orders; each view is
given twice, as a DataFrame and as SQL, and only the columns a query uses are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def articles(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), "source", "lang", (F.lit(2000) + F.pmod("doc_id", F.lit(25))).cast("int").alias("year"))

    @property
    def reviews(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.get_json_object("props", "$.k").cast("int").alias("document_id"),
            F.col("user_id").alias("expert_id"),
            F.pmod("user_id", F.lit(20)).alias("session_id"),
            F.col("event_type").alias("review_status"),
            "value",
            F.col("ts").alias("created_at"),
        )

    @property
    def sessions(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("CANCELLED")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("reviewer_id"), status.alias("status"), F.concat(F.lit("session "), F.col("o_orderkey")).alias("name"))

    @property
    def assignments(self) -> DataFrame:
        reviewed = self.reviews.select("session_id", F.col("document_id").cast("long").alias("article_id"), "expert_id")
        more = self.table("documents").select(F.pmod("doc_id", F.lit(20)).alias("session_id"), F.col("doc_id").alias("article_id"), F.pmod("doc_id", F.lit(150)).alias("expert_id"))
        return reviewed.unionByName(more).distinct()

    @property
    def users(self) -> DataFrame:
        role = F.when(F.col("c_mktsegment") == "BUILDING", "reviewer").when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("expert")
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.lower("c_name").alias("email"), role.alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"))

    @property
    def ai_labels(self) -> DataFrame:
        """Versioned labels of an article: the JSON payload and a confidence."""
        return self.table("events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("props").alias("payload"), F.col("value").alias("confidence"), F.col("ts").alias("created_at"))

    @property
    def adjudications(self) -> DataFrame:
        resolution = F.when(F.pmod("event_id", F.lit(3)) == 0, "RESOLVED").otherwise("ESCALATED")
        return self.table("events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("document_id"), F.pmod("user_id", F.lit(20)).alias("session_id"), F.col("user_id").alias("reviewer_id"), resolution.alias("resolution_status"), F.col("ts").alias("created_at"))

    @property
    def concepts(self) -> DataFrame:
        """One row per mention of a concept in an article."""
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        return self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("article_id"), F.col("p_name").alias("concept_name"), F.col("p_brand").alias("concept_code"), F.col("p_type").alias("concept_type"), (F.col("l_quantity") / 50).alias("confidence"))

    @property
    def aliases(self) -> DataFrame:
        """Alias candidates of dictionary concepts."""
        status = F.element_at(F.array(F.lit("PENDING_REVIEW"), F.lit("APPROVED"), F.lit("REJECTED")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("surface_form"), F.col("p_brand").alias("concept_code"), F.col("p_type").alias("match_method"), status.alias("status"), F.round(F.col("p_size") / 50, 5).alias("confidence"))

    @property
    def crawl_logs(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("crawled_at"), F.col("o_totalprice").alias("articles"))

    @property
    def qa(self) -> DataFrame:
        """Question and answer: each user turn and the assistant turn right after it."""
        turns = self.table("conversations").select("conv_id", "turn", "role", "text")
        later = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
        return turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(later, ["conv_id", "turn"])

    @property
    def splits(self) -> DataFrame:
        m = F.pmod("doc_id", F.lit(10))
        return self.table("documents").select("doc_id", "text", "lang", F.when(m == 0, "test").when(m == 1, "dev").otherwise("train").alias("split"))

    @property
    def tokens(self) -> DataFrame:
        """doc_id, pos and token of every document, in lower case."""
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
        return self.table("documents").select("doc_id", F.posexplode(words).alias("pos", "token"))

    def lexicon(self, low: int = 5) -> DataFrame:
        """key, df and label of the tokens that `low` documents hold or more, as a dictionary of terms.

        Repeats inside a document go before the shuffle, so a frequent token costs one row a document."""
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
        tokens = self.table("documents").select(F.explode(words).alias("key")).where("length(key) >= 6")
        counted = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= low)
        return counted.withColumn("label", term_label(F.col("key")))

    @property
    def gold(self) -> DataFrame:
        """Gold spans in token positions: every occurrence of a lexicon term."""
        return self.tokens.join(self.lexicon().select(F.col("key").alias("token"), "label"), "token").select("doc_id", F.col("pos").alias("s"), (F.col("pos") + 1).alias("e"), "label")

    @property
    def predicted(self) -> DataFrame:
        """Spans of another system: a wider lexicon, other labels for some terms, some spans too long."""
        terms = self.lexicon(3).select(F.col("key").alias("token"), "label")
        label = F.when(F.col("token").endswith("n"), "CAUSE").otherwise(F.col("label"))
        end = F.col("pos") + F.when(F.length("token") % 5 == 0, 2).otherwise(1)
        return self.tokens.join(terms, "token").select("doc_id", F.col("pos").alias("s"), end.alias("e"), label.alias("label"))


def term_label(key):
    return F.element_at(F.array(F.lit("DISEASE"), F.lit("SYMPTOM"), F.lit("TREATMENT")), F.length(key) % 3 + 1)


_LEXICON = "SELECT token AS key, count(DISTINCT doc_id) AS df, ['DISEASE', 'SYMPTOM', 'TREATMENT'][length(token) % 3 + 1] AS label FROM tokens WHERE length(token) >= 6 GROUP BY token HAVING count(DISTINCT doc_id) >= "

SQL = {
    "articles": "SELECT doc_id AS id, substring(text, 1, 80) AS title, text AS abstract, source, lang, (2000 + doc_id % 25)::INT AS year FROM documents",
    "reviews": "SELECT event_id AS id, json_extract_string(props, '$.k')::INT AS document_id, user_id AS expert_id, user_id % 20 AS session_id, event_type AS review_status, value, ts AS created_at FROM events",
    "sessions": "SELECT o_orderkey AS id, o_custkey AS reviewer_id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'CANCELLED' END AS status, 'session ' || o_orderkey AS name FROM orders",
    "assignments": "SELECT DISTINCT session_id, document_id::BIGINT AS article_id, expert_id FROM reviews UNION SELECT doc_id % 20, doc_id, doc_id % 150 FROM documents",
    "users": "SELECT c_custkey AS id, c_name AS full_name, lower(c_name) AS email, CASE c_mktsegment WHEN 'BUILDING' THEN 'reviewer' WHEN 'MACHINERY' THEN 'admin' ELSE 'expert' END AS role, c_acctbal >= 0 AS is_active FROM customer",
    "ai_labels": "SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT AS article_id, props AS payload, value AS confidence, ts AS created_at FROM events WHERE event_type = 'view'",
    "adjudications": "SELECT event_id AS id, json_extract_string(props, '$.k')::INT AS document_id, user_id % 20 AS session_id, user_id AS reviewer_id, CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'ESCALATED' END AS resolution_status, ts AS created_at FROM events WHERE event_type = 'purchase'",
    "concepts": "SELECT l_orderkey AS article_id, p_name AS concept_name, p_brand AS concept_code, p_type AS concept_type, l_quantity / 50 AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey",
    "aliases": "SELECT p_partkey AS id, p_name AS surface_form, p_brand AS concept_code, p_type AS match_method, ['PENDING_REVIEW', 'APPROVED', 'REJECTED'][p_partkey % 3 + 1] AS status, round(p_size / 50.0::DOUBLE, 5) AS confidence FROM part",
    "crawl_logs": "SELECT o_orderkey AS id, o_custkey AS source_id, o_orderstatus AS status, o_orderdate AS crawled_at, o_totalprice AS articles FROM orders",
    "qa": "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'",
    "splits": "SELECT doc_id, text, lang, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM documents",
    "tokens": r"SELECT doc_id, (unnest(range(len(a))))::INT AS pos, unnest(a) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents)",
    "lexicon": _LEXICON + "5",
    "wide_lexicon": _LEXICON + "3",
    "gold": "SELECT t.doc_id, t.pos AS s, t.pos + 1 AS e, l.label FROM tokens t JOIN lexicon l ON l.key = t.token",
    "predicted": "SELECT t.doc_id, t.pos AS s, t.pos + CASE WHEN length(t.token) % 5 = 0 THEN 2 ELSE 1 END AS e, CASE WHEN t.token LIKE '%n' THEN 'CAUSE' ELSE l.label END AS label FROM tokens t JOIN wide_lexicon l ON l.key = t.token",
}


def with_views(sql: str) -> str:
    """The statement with the views that it names, and those these name, defined in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, definition in SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(definition)
                if name not in needed:
                    needed.append(name)

    need(sql)
    own = re.match(r"\s*WITH\b(\s+RECURSIVE\b)?", sql, re.I)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    if not needed:
        return sql
    if own:
        return f"WITH{own[1] or ''} {views}, {sql[own.end():]}"
    return f"WITH {views} {sql}"
