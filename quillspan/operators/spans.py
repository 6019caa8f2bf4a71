"""Span algebra: overlap resolution, BIO coding, alignment, mark-aware tokens.

Spans are half-open code-point ranges. What needs a document's spans in sequence works on its array of
spans in an Arrow UDF; everything else is a join or window over exploded spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded

SPAN = "struct<start:int,end:int,label:string,rank:int>"
RESOLVED = "array<struct<start:int,end:int,label:string,rank:int,status:string,kept_start:int,kept_end:int>>"
#: Orders in which spans are accepted. rank is the caller's method, label or source rank.
ORDERS: dict[str, Callable[[dict], tuple]] = {
    "longest": lambda s: (s["start"] - s["end"], s["rank"], s["start"], s["end"], s["label"]),
    "source_first": lambda s: (s["rank"], s["start"] - s["end"], s["start"], s["end"], s["label"]),
    "shortest": lambda s: (s["end"] - s["start"], s["start"], s["end"], s["rank"], s["label"]),
    "leftmost": lambda s: (s["start"], s["start"] - s["end"], s["rank"], s["label"]),
    "longest_start": lambda s: (s["start"] - s["end"], s["start"], s["rank"], s["label"]),
}


def resolve_list(spans: list[dict], order: str) -> list[dict]:
    """Every span with KEPT, DUPLICATE or OVERLAP_DROPPED and the kept span it gave way to.

    Kept spans are flat: those in the way of a span are neighbours in a list sorted by start."""
    begins: list[int] = []
    kept: list[tuple[int, int, int]] = []  # end, turn of acceptance, start; beside begins
    seen, out = set(), []
    for turn, s in enumerate(sorted(spans, key=ORDERS[order])):
        identity = s["start"], s["end"], s["label"]
        at = low = bisect_left(begins, s["end"])
        while low and kept[low - 1][0] > s["start"]:
            low -= 1
        other = min(kept[low:at], key=lambda k: k[1], default=None)
        status = "DUPLICATE" if identity in seen else "OVERLAP_DROPPED" if other else "KEPT"
        seen.add(identity)
        if status == "KEPT":
            begins.insert(at, s["start"])
            kept.insert(at, (s["end"], turn, s["start"]))
        out.append({**s, "status": status, "kept_start": other[2] if other else None, "kept_end": other[0] if other else None})
    return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], s["rank"], s["status"]))


def resolve_overlaps(spans: Column, order: str = "longest") -> Column:
    """Greedy acceptance in one of ORDERS over an array of SPAN; null counts as empty."""

    @F.arrow_udf(RESOLVED)
    def resolve(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rank", pa.int32()), ("status", pa.string()), ("kept_start", pa.int32()), ("kept_end", pa.int32())]))
        for batch in bounded(batches):
            yield pa.array([resolve_list(x or [], order) for x in batch.to_pylist()], kind)

    return resolve(spans)


#: A word: letters and digits, and the marks that follow them.
_MARKED_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def tokens_of(text: str) -> list[dict]:
    """Words with their places; combining marks stay with their letter."""
    return [{"word": m.group(), "start": m.start(), "end": m.end()} for m in _MARKED_WORD.finditer(text)]


def mark_aware_tokens(text: Column) -> Column:
    @F.arrow_udf("array<struct<word:string,start:int,end:int>>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in bounded(batches):
            yield pa.array([tokens_of(x or "") for x in batch.to_pylist()], kind)

    return tokens(text)


def offset_tokens(text: Column, pattern: str = r"\w+(?:[-+]\w+)*|[^\w\s]") -> Column:
    """Tokens of a pattern with their offsets."""

    @F.arrow_udf("array<struct<word:string,start:int,end:int>>")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = re.compile(pattern).finditer
        kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in bounded(batches):
            yield pa.array([[{"word": m.group(), "start": m.start(), "end": m.end()} for m in find(x or "")] for x in batch.to_pylist()], kind)

    return tokens(text)


def sentences_of(text: str) -> list[dict]:
    """Ranges that end after . ! ? before white space or the end, or at an empty line; blank ones are left out."""
    out = []
    for m in re.finditer(r".*?(?:[.!?](?=\s|$)|\n{2,}|$)", text, re.S):
        piece = m.group()
        body = piece.strip()
        if body:
            start = m.start() + len(piece) - len(piece.lstrip())
            out.append({"start": start, "end": start + len(body)})
    return out


def sentence_ranges(text: Column) -> Column:
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def ranges(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in bounded(batches):
            yield pa.array([sentences_of(x or "") for x in batch.to_pylist()], kind)

    return ranges(text)


def bio_encode(tokens: DataFrame, spans: DataFrame, doc: str = "doc_id", outside: str = "O") -> DataFrame:
    """tokens (doc, pos, start, end) with a tag each, for flat spans (doc, s, e, label).

    A token inside a span is B- if it starts with it, else I-, else `outside`; spans that do not begin and
    end with tokens must be left out before (see boundary_issues). Tokens meet spans by document and cell
    of their range, so a long document is no one group."""
    own = tokens.select(doc, "pos", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    marks = spans.select(doc, F.col("s").alias("b_start"), F.col("e").alias("b_end"), "label")
    inside = overlapping(own, marks, doc).where("a_start >= b_start AND a_end <= b_end")
    tag = F.concat(F.when(F.col("a_start") == F.col("b_start"), "B-").otherwise("I-"), F.col("label"))
    tagged = inside.select(doc, "pos", tag.alias("tag"))
    return tokens.join(tagged, [doc, "pos"], "left").select(doc, "pos", "start", "end", F.coalesce("tag", F.lit(outside)).alias("tag"))


def boundary_issues(tokens: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans whose ends are not those of tokens."""
    starts = tokens.select(F.col(doc), F.col("start").alias("s"))
    ends = tokens.select(F.col(doc), F.col("end").alias("e"))
    good = spans.join(starts, [doc, "s"], "left_semi").join(ends, [doc, "e"], "left_semi")
    return spans.join(good.select(doc, "s", "e", "label"), [doc, "s", "e", "label"], "left_anti")


def bio_decode(tags: DataFrame, doc: str = "doc_id", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """Spans (doc, s, e, label) in token positions: islands of one label that a B- or a change opens."""
    w = Window.partitionBy(doc).orderBy(pos)
    label = F.when(F.col(tag).rlike("^[BI]-"), F.substring(tag, 3, 1000))
    rows = tags.withColumn("_label", label)
    opens = F.col("_label").isNotNull() & (F.col(tag).startswith("B-") | ~F.lag("_label").over(w).eqNullSafe(F.col("_label")))
    rows = rows.withColumn("_open", opens.cast("int")).withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("_label IS NOT NULL").groupBy(doc, "_island").agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e"), F.first("_label").alias("label")).drop("_island")


def overlapping(a: DataFrame, b: DataFrame, doc: str = "doc_id", how: str = "inner", cell: int = 64) -> DataFrame:
    """Pairs (or rows of a, for semi and anti) of spans of one document that overlap.

    Spans are dealt to cells of their range, so the join key is (document, cell) and a long document
    is not one group; a pair counts in the cell where the later of the two starts lies."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / cell).cast("int"), F.floor((e - 1) / cell).cast("int")))
    left = a.withColumn("_cell", cells(F.col("a_start"), F.col("a_end")))
    right = b.withColumn("_cell", cells(F.col("b_start"), F.col("b_end"))).withColumnRenamed(doc, "_doc").withColumnRenamed("_cell", "_b_cell")
    hit = (F.col(doc) == F.col("_doc")) & (F.col("_cell") == F.col("_b_cell")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    once = F.floor(F.greatest("a_start", "b_start") / cell).cast("int") == F.col("_cell")
    pairs = left.join(right, hit & once).drop("_cell", "_b_cell", "_doc")
    if how == "inner":
        return pairs
    return a.join(pairs.select(doc, "a_start", "a_end").distinct(), [doc, "a_start", "a_end"], "left_semi" if how == "semi" else "left_anti")


def entity_html(text: Column, spans: Column) -> Column:
    """The text escaped, with a mark around each of the flat spans in order (array of start, end, label)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ordered = F.array_sort(spans)
    piece = lambda s, i: F.concat(esc(F.substring(text, F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0)))), F.lit('<mark data-label="'), s["label"], F.lit('">'), esc(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"))
    last = F.coalesce(F.get(ordered, F.size(ordered) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(ordered, piece), ""), esc(F.substring(text, last + 1, F.length(text))))
