"""Queries over stored web pages, and readers and streams run over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, url
from ..operators.relational import reachable
from ..registry import query
from .views import Views


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages")


@query()
def cr03_article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.explode_outer(html.parse(F.col("html"), F.col("url"), "article_links")).alias("link")).distinct()


@query()
def cr02_next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.explode_outer(html.parse(F.col("html"), F.col("url"), "next_links")).alias("link"))


@query()
def cr01_issue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.explode_outer(html.parse(F.col("html"), F.col("url"), "issue_links")).alias("issue")).select("page_id", "issue.*")


@query()
def cr05_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.parse(F.col("html"), F.col("url"), "metadata").alias("m")).select("page_id", "m.*")


@query()
def cr08_question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.parse(F.col("html"), F.col("url"), "question_answer").alias("q")).select("page_id", "q.*")


@query("SELECT page_id, y AS year FROM (SELECT page_id, url, nullif(regexp_extract(url, '(20[0-9]{2})', 1), '')::INT AS y FROM pages) WHERE y IS NULL OR y BETWEEN 2000 AND 2020")
def cr09_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a range of years; an unknown year stays."""
    year = F.regexp_extract("url", "(20[0-9]{2})", 1)
    return _pages(spark, sf_dir).select("page_id", F.when(year != "", year.cast("int")).alias("year")).where("year IS NULL OR year BETWEEN 2000 AND 2020")


@query(r"SELECT lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '')) AS host, count(*) AS pages, sum(length(html))::BIGINT AS characters FROM pages GROUP BY ALL")
def cr10_host_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(url.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("characters"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 3) % 1500 AS b FROM orders), r AS (SELECT 3::BIGINT AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 12)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def cr04_reachable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first search over a stored link graph, twelve levels deep."""
    edges = Views(spark, sf_dir).table("orders").select(F.col("o_custkey").alias("a"), F.pmod(F.col("o_custkey") * 7 + 3, F.lit(1500)).alias("b")).distinct()
    return reachable(edges, spark.createDataFrame([(3,)], "node bigint"), 12)
