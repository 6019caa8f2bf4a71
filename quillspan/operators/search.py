"""Which texts contain which passages, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import runs_of

#: Words inside a passage that serve as its key.
KEY_WORDS = 3
WORD = r"([\p{L}\p{N}_]+)"


def containing(docs: DataFrame, passages: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item) for each text of docs (doc, text) that contains a passage (item, passage), at any place.

    Where a passage stands in a text, all its words but the first and last are whole words of the text,
    in the same order. Its second to fourth words are looked up among each text's distinct runs of three
    words; only hits are compared as text. Passages of fewer than five words have no such key and are
    compared with every text. Null texts and passages contain and match nothing."""
    words = F.regexp_extract_all("passage", F.lit(WORD), F.lit(1))
    items = passages.where("passage IS NOT NULL").withColumn("_w", words)
    keyed = items.where(F.size("_w") >= KEY_WORDS + 2).withColumn("_key", F.array_join(F.slice("_w", F.lit(2), F.lit(KEY_WORDS)), " ")).drop("_w")
    short = items.where(F.size("_w") < KEY_WORDS + 2).drop("_w")
    texts = docs.where("text IS NOT NULL").select(doc, "text")
    runs = texts.select(doc, F.explode(runs_of(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)), KEY_WORDS)).alias("_key"))
    hits = runs.join(keyed.select(item, "_key"), "_key").select(doc, item)
    found = hits.join(keyed.select(item, "passage"), item).join(texts, doc).where(F.contains("text", "passage")).select(doc, item)
    return found.unionByName(short.join(texts, F.contains("text", "passage")).select(doc, item))
