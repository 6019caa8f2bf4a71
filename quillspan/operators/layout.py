"""Layout operators over line tables: margins, reading order, headings, sections, paragraphs.

A line has doc_id, page, block_id, line_index, text, x0, y0, x1, y1, size, bold_ratio, page_width and
page_height. Pages and documents are the groups; a page's order is a sort key, not a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a page: its margin, the slack around the middle, and what counts as full width.
MARGIN, SLACK, FULL = 0.08, 0.08, 0.50


def in_margin() -> Column:
    return (F.col("y0") <= F.col("page_height") * MARGIN) | (F.col("y1") >= F.col("page_height") * (1 - MARGIN))


def boilerplate_key(text: Column) -> Column:
    """Text without digits and spacing: page numbers do not tell headers apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", ""), r"\s+", " "))


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines that are no running header or footer (a margin text of two pages or more) and no page number."""
    marked = lines.withColumns({"_margin": in_margin(), "_key": boilerplate_key(F.col("text"))})
    pages = marked.where(F.col("_margin") & (F.length("_key") >= 2)).groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("n"))
    repeated = pages.where("n >= 2").select("doc_id", "_key", F.lit(True).alias("_again"))
    number = F.col("_margin") & F.trim("text").rlike(r"(?i)^[dws]?\s*\d+$")
    out = marked.join(repeated, ["doc_id", "_key"], "left").where(~number & ~(F.col("_margin") & F.coalesce("_again", F.lit(False))))
    return out.select(*lines.columns)


def without_table_lines(lines: DataFrame, areas: DataFrame, share: float = 0.35) -> DataFrame:
    """Lines of which less than `share` lies inside a table area (doc_id, page, tx0, ty0, tx1, ty1)."""
    wide = F.greatest(F.least("x1", "tx1") - F.greatest("x0", "tx0"), F.lit(0.0))
    high = F.greatest(F.least("y1", "ty1") - F.greatest("y0", "ty0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = lines.join(areas, ["doc_id", "page"]).where((area > 0) & (wide * high >= share * area))
    keys = ["doc_id", "page", "block_id", "line_index"]
    return lines.join(inside.select(*keys).distinct(), keys, "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Add `order` (from 0, per document): full-width blocks cut a page into regions; a region of two
    columns is read left column first."""
    center, slack = F.col("page_width") / 2, F.col("page_width") * SLACK
    full = (F.col("x0") < center - slack) & (F.col("x1") > center + slack) & (F.col("x1") - F.col("x0") >= F.col("page_width") * FULL)
    mid = (F.col("y0") + F.col("y1")) / 2
    out = blocks.withColumns({"_full": full, "_at": F.when(full, F.col("y0")).otherwise(mid)})
    # a region's number is the count of full-width blocks that begin at or above it
    running = Window.partitionBy("doc_id", "page").orderBy("_at", F.desc("_full"), "x0", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("_region", F.sum(F.col("_full").cast("int")).over(running))
    region = Window.partitionBy("doc_id", "page", "_region")
    right = ~F.col("_full") & ((F.col("x0") + F.col("x1")) / 2 >= center)
    left = ~F.col("_full") & ~right
    out = out.withColumn("_right", right)
    two = F.bool_or(right).over(region) & F.bool_or(left).over(region)
    two = two & (F.min(F.when(right, F.col("x0") - (center - slack))).over(region) >= 0) & (F.max(F.when(left, F.col("x1") - (center + slack))).over(region) <= 0)
    out = out.withColumn("_column", F.when(F.col("_full"), -1).when(two & F.col("_right"), 1).otherwise(0))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_region", "_column", "y0", "x0", "block_id")) - 1
    return out.withColumn("order", order).select(*blocks.columns, "order")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id and body_size: the font size that most characters have (of equal ones the smaller)."""
    sums = lines.groupBy("doc_id", "size").agg(F.sum(F.greatest(F.length("text"), F.lit(1))).alias("n"))
    return sums.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def numbering_depth(text: Column) -> Column:
    token = F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)*|[ivxlcdm]+)\.?\s+", 1)
    return F.when(token == "", None).when(token.rlike(r"^\d"), F.size(F.split(token, r"\."))).otherwise(1)


def heading_score(lines: DataFrame, known: Column) -> DataFrame:
    """Add heading_score, weighted evidence from numbering, type size, weight, length, meaning and block.

    lines need body_size and block_line_count."""
    one = F.lit(1.0)
    parts = [
        (0.22, F.when(numbering_depth(F.col("text")).isNotNull(), 1.0).otherwise(0.0)),
        (0.20, F.round(F.least(one, F.greatest(F.lit(0.0), (F.col("size") - F.col("body_size") + 1.2) / 2.4)), 2)),
        (0.20, F.round(F.least(one, F.col("bold_ratio")), 2)),
        (0.10, F.when((F.length("text") <= 80) & (F.size(F.split(F.trim("text"), r"\s+")) <= 12), 1.0).otherwise(0.35)),
        (0.20, F.when(known, 1.0).otherwise(0.0)),
        (0.08, F.when(F.col("block_line_count") == 1, 1.0).otherwise(0.45)),
    ]
    return lines.withColumn("heading_score", F.round(reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in parts]), 3))


def headings(lines: DataFrame) -> DataFrame:
    """Lines that are headings by layout: 2 to 14 words alone in their block, larger or bolder than the body
    or in capitals, no list item, caption, sentence or contact line."""
    text = F.trim("text")
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))
    strong = (F.col("size") >= F.col("body_size") + 0.8) | (F.col("bold_ratio") >= 0.82) | ((F.upper(text) == text) & text.rlike(r"\p{L}") & (F.col("size") >= F.col("body_size") - 0.1))
    numbered = numbering_depth(text).isNotNull() & ((F.col("bold_ratio") >= 0.6) | (F.col("size") >= F.col("body_size") + 0.4))
    bad = text.rlike(r"^[-•*–]\s|[:;,]$|[.!?]\s+\S|@|https?://|www\.|(?i)^(table|figure|fig\.|bảng|hình)\s*\d") | text.rlike(r"^[\d\s.,;:/()\[\]-]+$")
    return lines.where((F.col("block_line_count") == 1) & words.between(2, 14) & F.length(text).between(3, 120) & (strong | numbered) & ~bad)


def section_bounds(heads: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add `end`: the next heading's position, or the document's length (doc_id, length) for the last."""
    w = Window.partitionBy("doc_id").orderBy("position")
    return heads.join(lengths, "doc_id").withColumn("end", F.coalesce(F.lead("position").over(w), F.col("length"))).drop("length")


def section_parents(heads: DataFrame) -> DataFrame:
    """Add parent_position: the last heading above with a smaller level, null at the top.

    level is 1 or more; one running value per level that occurs is carried down, so no stack is needed."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in heads.where("level IS NOT NULL").select("level").distinct().orderBy("level").collect()] or [1]
    last = {k: F.last(F.when(F.col("level") == k, F.col("position")), ignorenulls=True).over(w) for k in levels}
    out = heads.withColumns({f"_l{k}": c for k, c in last.items()})
    above = F.array(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in levels])
    return out.withColumn("parent_position", F.array_max(above)).drop(*[f"_l{k}" for k in levels])


def reflow(text: Column) -> Column:
    """Hyphenated line ends are joined, single line ends become spaces, empty lines part paragraphs, and a
    paragraph that does not end like a sentence takes the next one in."""
    joined = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])-[ \t]*\n\s*(?=\p{Ll})", "")
    paragraphs = F.filter(F.transform(F.split(joined, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")
    list_item = r"^(?:[-•*–]|\d+[.)]|[a-z][.)])\s"
    glue = lambda p, i: F.when((i > 0) & ~F.get(paragraphs, i - 1).rlike(r"[.!?:;\])”’]$") & ~p.rlike(list_item), F.concat(F.lit(" "), p)).when(i > 0, F.concat(F.lit("\n\n"), p)).otherwise(p)
    return F.array_join(F.transform(paragraphs, glue), "")


def supported(claims: DataFrame, blocks: DataFrame, claim: str = "claim") -> DataFrame:
    """Claims (doc_id, block_id, claim) whose text the named block holds, both without spacing and case."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return claims.join(blocks.select("doc_id", "block_id", F.col("text").alias("_text")), ["doc_id", "block_id"]).where((key(F.col(claim)) != "") & F.contains(key(F.col("_text")), key(F.col(claim)))).drop("_text")
