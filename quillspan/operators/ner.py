"""Dictionary recognition: n-gram candidates, flat selection, suggestions, merging with a model's terms.

A document's tokens are an array; runs of tokens as long as a term are tested against a bitmap of the terms'
hashes where they stand, and those that pass meet the dictionary in an equality join on the whole key, so no
document is compared with a whole dictionary. Spans are half-open.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.text import match_key_of, strip_marks_of
from .dictionary import suffix_end
from .spans import overlapping

#: How sure a match is by its method, and the order of methods among spans of one length.
CONFIDENCE = {"exact": 1.0, "alias": 0.98, "clinical_form": 0.97, "accentless": 0.94}
OTHER_CONFIDENCE = 0.96
METHOD_RANK = {"exact": 0, "abbreviation": 1, "alias": 2, "clinical_form": 2, "accentless": 3}
#: Confidence of a phrase that names several concepts, and suggestions shown per document.
AMBIGUOUS_CONFIDENCE, SUGGESTIONS = 0.25, 100
#: Fixed value: bits of the bitmap of key hashes (8 MB).
BITS = 1 << 26
#: Fixed value: shapes of terms that are listed; with more, runs are told by the lengths of their parts.
SHAPES = 1000
TOKENS = "array<struct<key:string,plain:string,start:int,end:int,tail:string>>"
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
_TAIL = regex.compile(r"[^\w\s]*")


def tokens_of(text: str) -> list[dict]:
    """Words (letters, digits and the marks on them) with their keys, places and the punctuation after them."""
    out = []
    for m in _WORD.finditer(text):
        key = match_key_of(m.group())
        out.append({"key": key, "plain": strip_marks_of(key), "start": m.start(), "end": m.end(), "tail": _TAIL.match(text, m.end()).group()})
    return out


def keyed_tokens(text: Column) -> Column:
    """tokens_of() as an array; null counts as empty. Normal forms are not in Spark, hence an Arrow UDF."""

    @F.arrow_udf(TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("key", pa.string()), ("plain", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string())]))
        for batch in bounded(batches):
            yield pa.array([tokens_of(x.as_py() or "") for x in batch], kind)

    return tokens(text)


def phrase_hits(docs: DataFrame, keys: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, key, bare, start, end, n and tail of the runs of tokens that may be keys; those in keys (key) are
    all among them. bare: the run has no marks.

    docs has doc and tokens (TOKENS). Runs are built for the lengths that keys have and tested in place
    against a bitmap of the keys' hashes (of fixed size, BITS), so that no row moves here."""
    sizes = sorted(r[0] for r in keys.select(F.size(F.split("key", " ")).alias("n")).distinct().collect())
    some = None
    for n in sizes or [1]:
        rows = docs.where(F.size("tokens") >= n).select(doc, F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens") - n), _run_of(n))).alias("w"))
        rows = rows.select(doc, "w.key", "w.bare", "w.start", "w.end", F.lit(n).alias("n"), "w.tail")
        some = rows if some is None else some.unionByName(rows)
    return maybe(some, keys)


def maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key may be in keys (key), all that are among them: a test in place against a bitmap."""
    at = f"cast(shiftright(xxhash64(key), 6) & {BITS // 64 - 1} as int)"
    return rows.join(F.broadcast(_bitmap(keys)), F.expr(f"(shiftright(_words[{at}], cast(xxhash64(key) & 63 as int)) & 1) = 1"), "left_semi")


def _run_of(n: int):
    def run(i: Column) -> Column:
        key, last = _joined("key", i, n), F.get("tokens", i + (n - 1))
        return F.struct(key.alias("key"), (key == _joined("plain", i, n)).alias("bare"), F.get("tokens", i)["start"].alias("start"), last["end"].alias("end"), last["tail"].alias("tail"))

    return run


def _joined(field: str, i: Column, n: int) -> Column:
    """The field of n tokens from place i on, joined by spaces."""
    if n <= 4:
        return F.concat_ws(" ", *[F.get("tokens", i + k)[field] for k in range(n)])
    return F.array_join(F.transform(F.slice("tokens", i + 1, F.lit(n)), lambda t: t[field]), " ")


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row with the bits that the keys' hashes set, as whole numbers of 64 bits."""
    words = keys.groupBy(F.expr(f"cast(shiftright(xxhash64(key), 6) & {BITS // 64 - 1} as int)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))")).alias("b"))
    found = words.toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[found["i"].to_numpy()] = found["b"].to_numpy()
    column = pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))
    return keys.sparkSession.createDataFrame(pa.table({"_words": column}))


def candidates(docs: DataFrame, index: DataFrame, accentless: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans of all runs of tokens that one concept's key names: start, end, method, confidence, concept.

    index: key, concept_id, code, category, alias_type, match_term and case_sensitive, a row a key.
    accentless: plain and key; it serves only runs that have no marks themselves and are no key. A
    case-sensitive term counts only in capitals. Punctuation that ends the dictionary's spelling is
    taken into the span. docs has doc, tokens and text. Both kinds of keys are one table, so a run is
    moved once."""
    exact = index.select(F.col("key").alias("_run"), "*", F.when(F.col("alias_type") == "canonical", "exact").otherwise(F.col("alias_type")).alias("method"), F.lit(False).alias("_bare"))
    spare = accentless.join(index.select(F.col("key").alias("plain")), "plain", "left_anti").join(index, "key")
    other = spare.select(F.col("plain").alias("_run"), *[F.col(c) for c in index.columns], F.lit("accentless").alias("method"), F.lit(True).alias("_bare"))
    known = exact.unionByName(other)
    hits = phrase_hits(docs, known.select(F.col("_run").alias("key")), doc).withColumnRenamed("key", "_run")
    both = hits.join(known, "_run").where("bare OR NOT _bare")
    end = F.col("end") + suffix_end(F.col("tail"), F.lit(0), F.col("match_term"))
    sure = F.lit(OTHER_CONFIDENCE)
    for method, value in CONFIDENCE.items():
        sure = F.when(F.col("method") == method, value).otherwise(sure)
    out = both.select(doc, "start", end.cast("int").alias("end"), "n", "key", "method", sure.alias("confidence"), "concept_id", "code", "category", "case_sensitive")
    capital = out.where("case_sensitive").join(docs.select(doc, "text"), doc).withColumn("_letters", F.regexp_replace(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), r"[^\p{L}]", ""))
    capital = capital.where("_letters <> '' AND _letters = upper(_letters)").select(out.columns)
    return out.where("NOT case_sensitive").unionByName(capital).drop("case_sensitive")


def method_rank(method: Column) -> Column:
    rank = F.lit(2)
    for name, value in METHOD_RANK.items():
        rank = F.when(method == name, value).otherwise(rank)
    return rank


def blockers(starts: list[int], ends: list[int]) -> list[int]:
    """Greedy acceptance in the given order: -1 for what is kept, else the first kept span in the way.

    Kept spans are flat, so those that overlap a span are neighbours in a sorted list."""
    out: list[int] = []
    begins: list[int] = []
    kept: list[int] = []  # places of the kept spans, by their start
    for i, (start, end) in enumerate(zip(starts, ends, strict=True)):
        at = bisect_left(begins, end)
        low = at
        while low and ends[kept[low - 1]] > start:
            low -= 1
        if low < at:
            out.append(min(kept[low:at]))
        else:
            begins.insert(at, start)
            kept.insert(at, i)
            out.append(-1)
    return out


def _blocked(starts: Column, ends: Column) -> Column:
    @F.arrow_udf("array<int>")
    def block(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in bounded(batches):
            yield pa.array([blockers(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return block(starts, ends)


def accept(spans: DataFrame, order: list[Column], doc: str = "doc_id", start: str = "start", end: str = "end") -> DataFrame:
    """Add kept, and kept_start and kept_end of the span in the way, for greedy acceptance in an order.

    Only spans that touch each other, over others, can matter to each other: a document falls into
    islands first, and each island is one small group, so a long document is no hot one."""
    before = Window.partitionBy(doc).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col(start) >= F.coalesce(F.max(end).over(before), F.col(start))).cast("int")
    upto = Window.partitionBy(doc).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.struct(*[F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("by"), F.struct(*spans.columns).alias("row")])
    islands = spans.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(upto))
    lists = islands.groupBy(doc, "_island").agg(F.array_sort(F.collect_list(row)).alias("a"))
    alone = lists.where(F.size("a") == 1).withColumn("b", F.array(F.lit(-1)))
    more = lists.where(F.size("a") > 1).withColumn("b", _blocked(F.transform("a", lambda x: x["row"][start]), F.transform("a", lambda x: x["row"][end])))
    way = lambda i, side: F.get("a", F.get("b", i))["row"][side]
    own = lambda x, i: F.struct(x["row"].alias("row"), (F.get("b", i) < 0).alias("kept"), F.when(F.get("b", i) >= 0, way(i, start)).alias("kept_start"), F.when(F.get("b", i) >= 0, way(i, end)).alias("kept_end"))
    each = alone.unionByName(more).select(F.explode(F.transform("a", own)).alias("x"))  # no row carries its island along
    return each.select("x.row.*", "x.kept", "x.kept_start", "x.kept_end")


def entities(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The flat selection of candidates(): longest first, then by method, place and code."""
    order = [F.col("start") - F.col("end"), method_rank(F.col("method")), F.col("start"), F.col("code"), F.col("concept_id")]
    return accept(found, order, doc).where("kept").drop("kept", "kept_start", "kept_end")


def label_selection(spans: DataFrame, priority: dict[str, int], doc: str = "doc_id") -> DataFrame:
    """Every span (start, end, label) with KEPT, DUPLICATE or OVERLAP_DROPPED: longest first, then by label.

    Of equal spans one goes on; a dropped one names the kept span in its way."""
    rank = F.lit(len(priority))
    for name, value in priority.items():
        rank = F.when(F.col("label") == name, value).otherwise(rank)
    same = Window.partitionBy(doc, "start", "end", "label")
    nth = F.row_number().over(same.orderBy(F.lit(0)))
    rows = spans.withColumn("_nth", nth)
    once = accept(rows.where("_nth = 1").drop("_nth"), [F.col("start") - F.col("end"), rank, F.col("start"), F.col("end"), F.col("label")], doc)
    judged = once.withColumn("status", F.when(F.col("kept"), "KEPT").otherwise("OVERLAP_DROPPED")).drop("kept")
    copies = rows.where("_nth > 1").drop("_nth").withColumns({"kept_start": F.lit(None).cast("int"), "kept_end": F.lit(None).cast("int"), "status": F.lit("DUPLICATE")})
    return judged.unionByName(copies.select(judged.columns))


def ambiguous_phrases(docs: DataFrame, many: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The longest run from each start whose key (of `many`) names several concepts: prompts, never entities."""
    hits = phrase_hits(docs, many.select("key"), doc).join(many, "key").repartition(doc)
    longest = F.row_number().over(Window.partitionBy(doc, "start").orderBy(F.desc("n")))
    return hits.withColumn("_r", longest).where("_r = 1").drop("_r", "tail", "bare").withColumn("confidence", F.lit(AMBIGUOUS_CONFIDENCE))


def shown_suggestions(suggestions: DataFrame, limit: int = SUGGESTIONS, doc: str = "doc_id") -> DataFrame:
    """The first suggestions of a document by start, end and method: what a review page shows."""
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("start", "end", "method", "key"))
    return suggestions.withColumn("_r", nth).where(F.col("_r") <= limit).drop("_r")


def without_overlaps(spans: DataFrame, others: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans that overlap none of the others."""
    a = spans.withColumnsRenamed({"start": "a_start", "end": "a_end"})
    b = others.select(doc, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlapping(a, b, doc, how="anti").withColumnsRenamed({"a_start": "start", "a_end": "end"})


def document_result(docs: DataFrame, chosen: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: text, entities in order, distinct concepts in order and counts by method.

    docs has doc and text; chosen is entities(). A concept is a key, code and category and shows its
    first mention. A document without entities has empty arrays."""
    fields = ["start", "end", F.col("category").alias("label"), "code", "concept_id", "method", "confidence"]
    lists = chosen.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("key", "code", "category", F.struct(*fields).alias("e")))).alias("_all"))
    text = lambda e: F.substring("text", e["start"] + 1, e["end"] - e["start"])
    shown = lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["end"].alias("end"), x["e"]["label"].alias("label"), text(x["e"]).alias("text"), *[x["e"][c].alias(c) for c in ("code", "concept_id", "method", "confidence")])
    same = lambda x, i, c: x[c].eqNullSafe(F.get("_all", i - 1)[c])
    first = F.filter("_all", lambda x, i: (i == 0) | ~(same(x, i, "key") & same(x, i, "code") & same(x, i, "category")))
    of = lambda m: F.struct(m.alias("method"), F.size(F.filter("_all", lambda x: x["e"]["method"] == m)).cast("long").alias("n"))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["e"]["method"]))), of))
    out = docs.select(doc, "text").join(lists, doc, "left").withColumn("_all", F.coalesce("_all", F.array().cast(lists.schema["_all"].dataType)))
    return out.select(doc, "text", F.array_sort(F.transform("_all", shown)).alias("entities"), F.array_sort(F.transform(first, shown)).alias("concepts"), counts.alias("counts"))


def places_of(keys: list[str], asked: list[str]) -> list[tuple[int, int, int]]:
    """(asked, first, last): runs of the keys that, joined by spaces, are one of those asked for."""
    by: dict[int, dict[str, list[int]]] = {}
    for k, key in enumerate(asked):
        by.setdefault(key.count(" ") + 1, {}).setdefault(key, []).append(k)
    out = []
    for n, wanted in by.items():
        for i in range(len(keys) - n + 1):
            for k in wanted.get(keys[i] if n == 1 else " ".join(keys[i : i + n]), ()):
                out.append((k, i, i + n - 1))
    return out


def _places(keys: Column, asked: Column) -> Column:
    @F.arrow_udf("array<struct<k:int,first:int,last:int>>")
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
        for a, b in bounded(batches):
            yield pa.array([[{"k": k, "first": i, "last": j} for k, i, j in places_of(x, y)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return places(keys, asked)


def surface_spans(docs: DataFrame, surfaces: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whole-token spans of each document's own surfaces (doc, key, ...): start and end are added.

    A document and its surfaces meet once, as one row; its tokens are not moved one by one."""
    asked = surfaces.where("key <> ''").groupBy(doc).agg(F.collect_list(F.struct(*surfaces.columns)).alias("_asked"))
    field = lambda name: F.transform("tokens", lambda t: t[name]).alias(f"_{name}")
    words = docs.where(F.size("tokens") > 0).select(doc, field("key"), field("start"), field("end"))
    both = words.join(asked, doc).withColumn("_p", F.explode(_places(F.col("_key"), F.transform("_asked", lambda x: x["key"]))))
    return both.select(F.get("_asked", F.col("_p.k")).alias("_a"), F.get("_start", F.col("_p.first")).alias("start"), F.get("_end", F.col("_p.last")).alias("end")).select("_a.*", "start", "end")


def not_inside(spans: DataFrame, longer: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spans that lie in no longer one of the others."""
    a = spans.withColumnsRenamed({"start": "a_start", "end": "a_end"})
    b = longer.select(doc, F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    keys = a.select(doc, "a_start", "a_end").distinct()
    inside = overlapping(keys, b, doc).where("b_start <= a_start AND a_end <= b_end AND b_end - b_start > a_end - a_start")
    kept = a.join(inside.select(doc, "a_start", "a_end").distinct(), [doc, "a_start", "a_end"], "left_anti")
    return kept.withColumnsRenamed({"a_start": "start", "a_end": "end"})


def merged_labels(docs: DataFrame, model: DataFrame, chosen: DataFrame, categories: dict[str, str], allowed: tuple[str, ...], doc: str = "doc_id") -> DataFrame:
    """A model's terms and the dictionary's entities as items: doc, category, key, code, source and spans.

    model: doc, category, key; chosen: doc, start, end, key, code, category. The dictionary decides: all
    its entities stay, under the category that `categories` maps theirs to, and a model's term with the
    same key adds nothing to them. Of the rest, terms that the text does not have go, as do spans inside
    a longer dictionary span and categories that are not allowed."""
    mapped = F.lit(allowed[0])
    for name, value in categories.items():
        mapped = F.when(F.col("category") == name, value).otherwise(mapped)
    spans = F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    known = chosen.withColumn("category", mapped)
    ours = known.groupBy(doc, "category", "key", "code").agg(spans).withColumn("source", F.lit("ai+dictionary"))
    keys = chosen.select(doc, "key").distinct()
    theirs = model.where(F.col("category").isin(*allowed)).select(doc, "category", "key").distinct().join(keys, [doc, "key"], "left_anti")
    found = not_inside(surface_spans(docs, theirs, doc), chosen, doc)
    alone = found.groupBy(doc, "category", "key").agg(spans).withColumns({"code": F.lit(""), "source": F.lit("ai")})
    columns = [doc, "category", "key", "code", "source", "spans"]
    return ours.select(columns).unionByName(alone.select(columns))


def bounded_terms(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, end, term and its other columns for each place where a term (in lower case) stands as it
    is written, between characters that are no letter, digit or underscore.

    A term is cut into words and what stands around them. Its shape is the latter; a run of words whose
    surroundings have a term's shape meets the terms by an equality join on the whole spelling. Neither a text
    nor a word that belongs to no shape is moved, and a common first word costs nothing. Terms without a
    letter or digit have no word and are not found."""
    word = r"[\p{L}\p{N}_]+"
    low = F.lower(F.col("term"))
    parts = lambda c: (F.regexp_extract_all(c, F.lit(f"({word})"), F.lit(1)), F.split(c, word, -1))
    words, gaps = parts(low)
    asked = terms.withColumns({"_low": low, "_n": F.size(words), "_gaps": gaps}).where("_n > 0")
    shapes = [tuple(r[0]) for r in asked.select("_gaps").distinct().limit(SHAPES + 1).collect()]
    if len(shapes) > SHAPES:  # too many to be listed: by the number of words and the lengths around them
        shapes = [(" " * r[1], *[None] * (r[0] - 1), " " * r[2]) for r in asked.select("_n", F.length(F.col("_gaps")[0]), F.length(F.element_at("_gaps", -1))).distinct().collect()]
        anyhow = True
    else:
        anyhow = False
    own_words, own_gaps = parts(F.lower(F.col(text)))
    docs = docs.select(F.col(doc).alias("_doc"), own_words.alias("_words"), own_gaps.alias("_gaps")).where(F.size("_words") > 0)
    found = docs.select("_doc", F.explode(_shaped(F.col("_words"), F.col("_gaps"), shapes, anyhow)).alias("x")).select("_doc", "x.start", "x.spelled")
    hit = found.join(asked, F.col("spelled") == F.col("_low"))
    return hit.select(F.col("_doc").alias(doc), "start", (F.col("start") + F.length("spelled")).cast("int").alias("end"), *terms.columns)


def shaped_runs(words: list[str], gaps: list[str], shapes: list[tuple], anyhow: bool) -> list[tuple[int, str]]:
    """(start, spelling) of each run of words that has one of the shapes: what stands before, between and after.

    What stands before and after is the end and the beginning of the gap there; it has no letter, digit or
    underscore, so a gap that is longer gives a boundary. With anyhow only its length and the count of words decide."""
    starts, at = [], 0
    for gap, w in zip(gaps, words, strict=False):
        starts.append(at + len(gap))
        at += len(gap) + len(w)
    by: dict[tuple, list[tuple[str, str]]] = {}
    for shape in shapes:
        by.setdefault(shape[1:-1], []).append((shape[0], shape[-1]))
    sizes = {len(inner) for inner in by}
    out = []
    for i in range(len(words)):
        for n in sizes:
            if i + n >= len(words):
                continue
            inner = tuple(gaps[i + 1 : i + n + 1])
            ends = by.get((None,) * n if anyhow else inner)
            if not ends:
                continue
            body = words[i] + "".join(g + w for g, w in zip(inner, words[i + 1 : i + n + 1], strict=True))
            lead, tail = gaps[i], gaps[i + n + 1]
            for before, after in ends:
                if (before and i and len(before) == len(lead)) or (after and i + n + 1 < len(words) and len(after) == len(tail)):
                    continue  # another word begins or ends right there
                if anyhow:
                    if len(before) <= len(lead) and len(after) <= len(tail):
                        out.append((starts[i] - len(before), lead[len(lead) - len(before) :] + body + tail[: len(after)]))
                elif lead.endswith(before) and tail.startswith(after):
                    out.append((starts[i] - len(before), before + body + after))
    return out


def _shaped(words: Column, gaps: Column, shapes: list[tuple], anyhow: bool) -> Column:
    @F.arrow_udf("array<struct<start:int,spelled:string>>")
    def runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("spelled", pa.string())]))
        for a, b in bounded(batches):
            yield pa.array([[{"start": i, "spelled": t} for i, t in shaped_runs(x, y, shapes, anyhow)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return runs(words, gaps)


def longest_terms(hits: DataFrame, limit: int = 40, doc: str = "doc_id") -> DataFrame:
    """Flat selection of bounded_terms(), longest first, and of each document the first `limit` in place."""
    kept = accept(hits, [F.col("start") - F.col("end"), F.col("start"), F.col("term")], doc).where("kept")
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("start"))
    return kept.withColumn("_r", nth).where(F.col("_r") <= limit).drop("_r", "kept", "kept_start", "kept_end")


def first_terms(hits: DataFrame, limit: int = 40, doc: str = "doc_id") -> DataFrame:
    """Flat selection in the order of terms by length, then spelling; it ends after `limit` spans of a document."""
    order = [-F.length("term"), F.col("term"), F.col("start")]
    kept = accept(hits, order, doc).where("kept")
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return kept.withColumn("_r", nth).where(F.col("_r") <= limit).drop("_r", "kept", "kept_start", "kept_end")
