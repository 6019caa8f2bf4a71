"""Scalar text, URL, hash and score functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions import url as urls
from ..registry import query
from .views import Views

_DOC = "documents"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table(_DOC)


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS match_key FROM documents")
def fn01_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.match_key(F.col("text")).alias("match_key"))


#: Lower case as case folding gives it: sharp s becomes ss.
_FOLD = "replace(lower(nfc_normalize(%s)), 'ß', 'ss')"


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all({_FOLD % 'text'}, '[\p{{L}}\p{{N}}]+'), ' ') AS match_key FROM documents")
def fn01_normalize_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general path: normal form and case folding, sharp s too."""
    return _docs(spark, sf_dir).select("doc_id", text.normalize_match_text(F.col("text")).alias("match_key"))


@query(rf"SELECT doc_id, strip_accents(replace(array_to_string(regexp_extract_all({_FOLD % 'text'}, '[\p{{L}}\p{{N}}]+'), ' '), 'đ', 'd')) AS plain FROM documents")
def fn02_strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.strip_diacritics(F.col("text")).alias("plain"))


@query(rf"""SELECT doc_id, pos, array_to_string(regexp_extract_all(regexp_replace(strip_accents(replace({_FOLD % "line"}, 'đ', 'd')), '^([0-9]+([.][0-9]+)*[.]?|([ivxlcdm]+|[a-z])[.])\s+', ''), '[a-z0-9]+'), ' ') AS heading_key
FROM (SELECT doc_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))""")
def fn03_normalize_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a heading."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", text.normalize_heading(F.col("line")).alias("heading_key"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(replace({_FOLD % 'text'}, 'đ', 'd')), '[a-z0-9]+'), '-') AS slug FROM documents")
def fn04_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(r"SELECT page_id, trim(regexp_replace(replace(html, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS clean FROM pages")
def fn05_normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages").select("page_id", text.collapse_space(F.col("html")).alias("clean"))


def _nested(sql: str, moves: list[tuple[str, str]]) -> str:
    for old, new in moves:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


#: Spellings with the tone on the first vowel and on the second one.
_TONES = "òa oà óa oá ỏa oả õa oã ọa oạ òe oè óe oé ỏe oẻ õe oẽ ọe oẹ ùy uỳ úy uý ủy uỷ ũy uỹ ụy uỵ ùa uà úa uá ủa uả ũa uã ụa uạ".split()
_LOWER = list(zip(_TONES[::2], _TONES[1::2], strict=True))
_MOVES = _LOWER + [(a.upper(), b.upper()) for a, b in _LOWER] + [(a.capitalize(), b.capitalize()) for a, b in _LOWER]


@query(f"SELECT doc_id, {_nested('text', _MOVES)} AS moved FROM documents")
def fn06_tone_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.move_tones(F.col("text")).alias("moved"))


@query(r"""SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: regexp_full_match(lower(x), '[a-z]{2,}'))) * 2 > len(w) AS needs FROM (
SELECT doc_id, list_filter(string_split(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)""")
def fn08_needs_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.needs_tones(F.col("text")).alias("needs"))


@query(r"SELECT page_id, trim(regexp_replace(url, '[<>:\"/\\|?*\x00-\x1F]', '_', 'g')) AS component FROM pages")
def fn11_file_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages").select("page_id", text.file_component(F.col("url")).alias("component"))


@query(r"""SELECT doc_id, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') || '...' ELSE array_to_string(w, ' ') END AS name FROM (
SELECT doc_id, list_filter(string_split(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)""")
def fn11_compact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.compact_name(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN rtrim(substring(text, 1, 300)) || '...' ELSE text END AS preview FROM documents")
def fn12_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def fn13_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query()
def fn14_similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_type")
    return part.select("p_partkey", text.similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))


def _tokens_sql(join: str) -> str:
    return rf"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, chr(10))) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+{join}|[^\p{{L}}\p{{N}}_ \t\n\x0B\f\r]') AS t FROM documents)"


def _tokens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = F.regexp_extract_all("text", F.lit(text.TOKENS[name]), F.lit(1))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, "\n"), 256).alias("digest"))


@query(_tokens_sql(r"(?:[-+][\p{L}\p{N}_]+)*"))
def fn15_tokens_joined_hyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "joined_hyphen")


@query(_tokens_sql(r"(?:[-/][\p{L}\p{N}_]+)*"))
def fn15_tokens_joined_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "joined_slash")


@query(_tokens_sql(""))
def fn15_tokens_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "plain")


@query("SELECT doc_id, i AS start FROM documents, range(length(text)) t(i) WHERE substring(text, (i + 1)::INT, 4) = 'tion'")
def fn19_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of one phrase in every document, overlapping ones too."""
    docs = _docs(spark, sf_dir).where("contains(text, 'tion')")
    return docs.select("doc_id", F.explode(text.occurrences(F.col("text"), "tion")).alias("start")).select("doc_id", F.col("start").cast("long").alias("start"))


@query("""SELECT doc_id, s, substring(text, greatest(s - 50, 0) + 1, least(s + 5 + 50, length(text)) - greatest(s - 50, 0)) AS context
FROM (SELECT doc_id, text, unnest(list_filter(range(length(text)), lambda i: text[i + 1:i + 4] = 'tion')) AS s FROM documents WHERE contains(text, 'tion'))""")
def fn20_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty characters on both sides of every hit; pieces between hits give their places."""
    docs = _docs(spark, sf_dir).where("contains(text, 'tion')")
    hits = docs.select("doc_id", "text", F.explode(text.separate_hits(F.col("text"), "tion")).alias("s"))
    return hits.select("doc_id", F.col("s").cast("long").alias("s"), text.context(F.col("text"), F.col("s"), F.col("s") + 5, 50).alias("context"))


@query("""SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '')) AS host,
  lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '')) LIKE '%.org' AS allowed FROM pages""".replace("\\\\", "\\"))
def fn30_host_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Views(spark, sf_dir).table("pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return pages.select("page_id", "host", F.col("host").endswith(".org").alias("allowed"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) ||
  coalesce(nullif(rtrim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/'), ''), '/') AS canonical FROM pages""")
def fn31_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^([a-z]+://[^/?#]+/[^/?#]*)', 1) AS base FROM pages")
def fn32_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("pages").select("page_id", urls.without_fragment(F.col("url")).alias("bare"), F.regexp_extract("url", "^([a-z]+://[^/?#]+/[^/?#]*)", 1).alias("base"))


@query(r"SELECT doc_id, regexp_extract(' ' || text || ' ', '[^0-9](20[0-9]{2})[^0-9]', 1) AS year FROM documents")
def fn33_year_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.regexp_extract("text", r"(?<!\d)(20\d{2})(?!\d)", 1).alias("year"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, coalesce(try_strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ'), TIMESTAMP '1970-01-01') AS parsed FROM events")
def fn34_iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Views(spark, sf_dir).table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    parsed = F.coalesce(F.try_to_timestamp("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.to_timestamp(F.lit("1970-01-01")))
    return events.select("event_id", "iso", parsed.cast("timestamp_ntz").alias("parsed"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def fn36_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN u <= 0 THEN 0.0::DOUBLE ELSE c / u END AS iou FROM (
SELECT *, greatest(least(a1, b1) - greatest(a0, b0), 0)::DOUBLE AS c, (a1 - a0) + (b1 - b0) - greatest(least(a1, b1) - greatest(a0, b0), 0) AS u
FROM (SELECT *, l_partkey % 50 AS a0, l_partkey % 50 + l_quantity::INT AS a1, l_suppkey % 50 AS b0, l_suppkey % 50 + l_linenumber * 5 AS b1 FROM lineitem))""")
def fn37_span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Views(spark, sf_dir).table("lineitem")
    a0, b0 = F.pmod("l_partkey", F.lit(50)), F.pmod("l_suppkey", F.lit(50))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scores.iou(a0, a0 + F.col("l_quantity").cast("int"), b0, b0 + F.col("l_linenumber") * 5).alias("iou"))


@query("""SELECT p_partkey, least(0.99, 0.55 + 0.15 * b + 0.15 * least(1.0, df / 3) + 0.10 * c + 0.05 * least(1.0, greatest(0.0, mi) / 5)) AS confidence,
  0.6 * (1 - least(0.99, 0.55 + 0.15 * b + 0.15 * least(1.0, df / 3) + 0.10 * c + 0.05 * least(1.0, greatest(0.0, mi) / 5))) + 0.4 * least(1.0, df / 5) AS priority
FROM (SELECT p_partkey, (p_partkey % 2)::DOUBLE AS b, (p_size % 7)::DOUBLE AS df, (p_partkey % 3 / 3.0)::DOUBLE AS c, (p_retailprice / 300 - 2)::DOUBLE AS mi FROM part)""")
def fn38_alias_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Views(spark, sf_dir).table("part")
    confidence = scores.alias_confidence(F.pmod("p_partkey", F.lit(2)).cast("double"), F.pmod("p_size", F.lit(7)).cast("double"), F.pmod("p_partkey", F.lit(3)) / 3, F.col("p_retailprice") / 300 - 2)
    scored = part.select("p_partkey", "p_size", confidence.alias("confidence"))
    return scored.select("p_partkey", "confidence", scores.alias_priority(F.col("confidence"), F.pmod("p_size", F.lit(7)).cast("double")).alias("priority"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 1.0 WHEN 'Brand#12' THEN 0.98 WHEN 'Brand#13' THEN 0.97 WHEN 'Brand#21' THEN 0.94 ELSE 0.96 END::DOUBLE AS confidence FROM part")
def fn39_method_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = F.create_map(*[F.lit(x) for pair in (("Brand#11", "exact"), ("Brand#12", "alias"), ("Brand#13", "clinical_form"), ("Brand#21", "accentless")) for x in pair])
    method = F.coalesce(methods[F.col("p_brand")], F.lit("other"))
    return Views(spark, sf_dir).table("part").select("p_partkey", scores.method_confidence(method).alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w * h <= 0 THEN 0.0 ELSE greatest(least(x + w, 60) - greatest(x, 20), 0.0) * greatest(least(y + h, 40) - greatest(y, 10), 0.0) / (w * h) END AS overlap
FROM (SELECT *, (l_partkey % 70)::DOUBLE AS x, (l_suppkey % 50)::DOUBLE AS y, l_quantity AS w, (l_linenumber * 4)::DOUBLE AS h FROM lineitem)""")
def fn40_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Views(spark, sf_dir).table("lineitem")
    x, y = F.pmod("l_partkey", F.lit(70)).cast("double"), F.pmod("l_suppkey", F.lit(50)).cast("double")
    a = {"x0": x, "y0": y, "x1": x + F.col("l_quantity"), "y1": y + F.col("l_linenumber") * 4}
    b = {k: F.lit(float(n)) for k, n in (("x0", 20), ("y0", 10), ("x1", 60), ("y1", 40))}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", scores.box_overlap(a, b).alias("overlap"))


@query("""SELECT event_id, u.key AS category, u.value AS n FROM (SELECT event_id, unnest(map_entries(MAP {'k': json_extract_string(props, '$.k'), 'kind': event_type})) AS u FROM events)""")
def fn45_payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Views(spark, sf_dir).table("events")
    payload = F.from_json("props", "map<string,string>")
    return events.select("event_id", F.explode(F.map_concat(payload, F.create_map(F.lit("kind"), F.col("event_type")))).alias("category", "n"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END, event_type) AS entity FROM events""")
def fn47_payload_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several payload forms that is there; a broken one counts as absent."""
    raw = F.when(F.col("event_id") % 2 == 0, F.lit("not json")).otherwise(F.col("props"))
    return Views(spark, sf_dir).table("events").select("event_id", F.coalesce(F.from_json(raw, "k string")["k"], F.col("event_type")).alias("entity"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, greatest(4, length(p_partkey::VARCHAR))::INT, '0') || '_' || lpad((p_partkey * 7)::VARCHAR, greatest(6, length((p_partkey * 7)::VARCHAR))::INT, '0') AS padded FROM part")
def fn48_padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).table("part").select("p_partkey", F.format_string("%04d_%06d", "p_partkey", F.col("p_partkey") * 7).alias("padded"))


@query("""SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next_token FROM tokens""")
def tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return Views(spark, sf_dir).tokens.withColumn("next_token", F.lead("token").over(w))


@query(r"""WITH w AS MATERIALIZED (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents), u AS MATERIALIZED (SELECT token, count(*)::DOUBLE AS c FROM (SELECT unnest(a) AS token FROM w) GROUP BY token),
b AS MATERIALIZED (SELECT x, y, count(*) AS n FROM (SELECT unnest(a[1:len(a) - 1]) AS x, unnest(a[2:]) AS y FROM w WHERE len(a) > 1) GROUP BY ALL HAVING count(*) >= 3)
SELECT b.x, b.y, b.n, log2(b.n * (SELECT sum(c) FROM u) / (u.c * v.c)) AS pmi FROM b JOIN u ON u.token = b.x JOIN u v ON v.token = b.y""")
def bigram_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointwise mutual information of neighbours seen three times or more.

    Neighbours are paired inside each document's token array, so no window shuffles tokens."""
    v = Views(spark, sf_dir)
    words = v.table("documents").select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("t"))
    unigrams = words.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    pairs = F.zip_with(F.col("t"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))), lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    bigrams = words.select(F.explode(pairs).alias("p")).select("p.*").where("y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    total = unigrams.agg(F.sum("c").cast("double").alias("total"))
    out = bigrams.join(unigrams.select(F.col("token").alias("x"), F.col("c").alias("cx")), "x").join(unigrams.select(F.col("token").alias("y"), F.col("c").alias("cy")), "y").join(F.broadcast(total))
    return out.select("x", "y", "n", F.log2(F.col("n") * F.col("total") / (F.col("cx").cast("double") * F.col("cy"))).alias("pmi"))
