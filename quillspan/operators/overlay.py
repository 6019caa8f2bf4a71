"""Approved aliases laid over a dictionary of terms, and synonym copies of annotated records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_by


def _identity(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))


def overlay_aliases(terms: DataFrame, aliases: DataFrame, key: Column) -> DataFrame:
    """terms (key, concept_id, code, canonical_term, ord) and the aliases that resolve, with `source`.

    aliases has surface_form, concept_id, concept_code, canonical_term and ord; key is the match key of
    surface_form. An alias takes the first term (least ord) whose id or code is its concept id, or else
    its code; without one it is left out, as is an alias whose key is empty or in the dictionary. Of
    several aliases with one key the first counts. Nulls count as empty."""
    names = terms.select(F.explode(F.array(_identity("concept_id"), _identity("code"))).alias("identity"), "concept_id", "code", F.col("canonical_term").alias("base_term"), "ord").where("identity IS NOT NULL")
    base = latest_by(names, ["identity"], [F.asc("ord"), F.asc("concept_id"), F.asc("code"), F.asc("base_term")]).select("identity", F.struct("concept_id", "code", "base_term").alias("base"))
    asked = aliases.select(key.alias("key"), _identity("concept_id").alias("by_id"), _identity("concept_code").alias("by_code"), F.nullif(F.trim("canonical_term"), F.lit("")).alias("own_term"), "ord").where("key <> ''")
    asked = asked.join(terms.select("key"), "key", "left_anti")
    found = asked.join(base.select(F.col("identity").alias("by_id"), F.col("base").alias("b1")), "by_id", "left").join(base.select(F.col("identity").alias("by_code"), F.col("base").alias("b2")), "by_code", "left")
    found = found.withColumn("base", F.coalesce("b1", "b2")).where("base IS NOT NULL")
    first = latest_by(found, ["key"], [F.asc("ord"), F.asc("base"), F.asc("own_term")])
    added = first.select("key", "base.concept_id", "base.code", F.coalesce("own_term", "base.base_term").alias("canonical_term"), F.lit("approved_alias").alias("source"))
    return terms.select("key", "concept_id", "code", "canonical_term", F.lit("dictionary").alias("source")).unionByName(added)


def synonym_copies(records: DataFrame, synonyms: DataFrame, labels: Iterable[str], per_record: int = 1) -> DataFrame:
    """Copies of records (id, text, entities) with one entity's text replaced.

    entities are structs (start, end, label, text) in code points; synonyms has text and replacement (one
    row a text). The first per_record entities of these labels with another, non-empty replacement
    give one copy each; spans from the replaced one's end on are shifted. Only ids, places and entity
    texts are joined and ranked, the record once more at the end. Adds entity_index, replaced and replacement."""
    spans = records.select("id", F.posexplode("entities").alias("entity_index", "e")).where(F.col("e.label").isin(*labels))
    known = synonyms.select("text", F.trim("replacement").alias("replacement")).where("replacement <> '' AND replacement <> text")
    hits = spans.select("id", "entity_index", F.col("e.text").alias("text")).join(known, "text").withColumnRenamed("text", "replaced")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("entity_index"))
    chosen = hits.withColumn("_n", nth).where(F.col("_n") <= per_record).drop("_n")
    e = F.element_at("entities", F.col("entity_index") + 1)
    size = F.length("replacement")
    delta = size - (e["end"] - e["start"])

    def moved(x: Column, i: Column) -> Column:
        own = F.struct(e["start"].alias("start"), (e["start"] + size).alias("end"), x["label"].alias("label"), F.col("replacement").alias("text"))
        shifted = F.struct((x["start"] + delta).alias("start"), (x["end"] + delta).alias("end"), x["label"].alias("label"), x["text"].alias("text"))
        return F.when(i == F.col("entity_index"), own).when(x["start"] >= e["end"], shifted).otherwise(x)

    text = F.concat(F.substring("text", F.lit(1), e["start"]), F.col("replacement"), F.substring("text", e["end"] + 1, F.length("text")))
    out = records.join(chosen, "id").withColumns({"text": text, "entities": F.transform("entities", moved)})
    return out.withColumn("id", F.concat_ws(":", F.col("id").cast("string"), F.lit("aug"), F.col("entity_index").cast("string")))
