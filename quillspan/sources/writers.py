"""Writers: JSON lines, CoNLL text, BRAT, metric tables, chat-tuning records, routed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running_total


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; the committer makes the whole write appear at once."""
    df.write.mode(mode).json(path)


def bio_lines(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc and its CoNLL text: token, tab, tag; an empty line after . ! ? and at the end."""
    last = Window.partitionBy(doc)
    marked = tokens.withColumn("_last", F.max("pos").over(last) == F.col("pos"))
    line = F.concat_ws("\t", "token", "tag")
    body = F.when(F.col("token").isin(".", "!", "?") & ~F.col("_last"), F.concat(line, F.lit("\n"))).otherwise(line)
    grouped = marked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", body.alias("line")))).alias("l"))
    return grouped.select(doc, F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("text"))


def line_index(texts: DataFrame, order: str, parts: str = "part") -> DataFrame:
    """Add start_line and end_line (from 1) of each text in a file that holds all of a part in a
    whole-number order."""
    lines = F.size(F.split("text", "\n", -1)) - 1
    out = running_total(texts.withColumn("_n", lines), [parts], order, F.col("_n"), "end_line")
    return out.withColumn("start_line", F.col("end_line") - F.col("_n") + 1).drop("_n")


def brat_lines(entities: Column) -> Column:
    """Stand-off text of an array of (start, end, label, text), in order."""
    ordered = F.array_sort(entities)
    return F.array_join(F.transform(ordered, lambda e, i: F.concat(F.lit("T"), (i + 1).cast("string"), F.lit("\t"), e["label"], F.lit(" "), e["start"].cast("string"), F.lit(" "), e["end"].cast("string"), F.lit("\t"), F.regexp_replace(e["text"], "\n", " "))), "\n")


def chat_records(df: DataFrame, system: str, prompt: Column, answer: Column) -> DataFrame:
    """A column `record` with one tuning example as JSON: a system instruction, a user and a model turn."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))
    instruction = F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit(system).alias("text"))).alias("parts"))
    return df.withColumn("record", F.to_json(F.struct(instruction.alias("systemInstruction"), F.array(turn("user", prompt), turn("model", answer)).alias("contents"))))


def write_metrics(metrics: DataFrame, path: str, mark: bool = True) -> None:
    """A CSV of a metric table, led by a byte-order mark that spreadsheets look for.

    The table has one row a label, so one file holds it."""
    first = metrics.columns[0]
    marked = metrics.withColumnRenamed(first, "\ufeff" + first) if mark else metrics
    marked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(metrics: DataFrame, title: str) -> str:
    """A Markdown table of a small metric table (one row a label)."""
    rows = metrics.orderBy("label").limit(1000).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def unique_names(df: DataFrame, base: str, order: Column, name: str = "stem") -> DataFrame:
    """Add a name that no other row has: the base, and _2, _3 ... for its later rows in order."""
    w = Window.partitionBy(base).orderBy(order)
    n = F.row_number().over(w)
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), F.col("_n")))).drop("_n")


def sequence_names(df: DataFrame, slug: str, order: Column, existing: DataFrame | None = None) -> DataFrame:
    """Add slug_000001 and so on, going on after the highest number that `existing` (slug, n) has."""
    w = Window.partitionBy(slug).orderBy(order)
    out = df.withColumn("_n", F.row_number().over(w))
    if existing is not None:
        out = out.join(existing.groupBy(slug).agg(F.max("n").alias("_had")), slug, "left").withColumn("_n", F.col("_n") + F.coalesce("_had", F.lit(0))).drop("_had")
    return out.withColumn("name", F.format_string("%s_%06d", slug, "_n")).drop("_n")


def collision_names(df: DataFrame, name: str, digest: Column, existing: DataFrame) -> DataFrame:
    """Add `target`: the name, or name_hash.ext with the first ten characters of the digest where `existing`
    (name) has it already."""
    stem, ending = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    taken = existing.select(name).distinct().withColumn("_taken", F.lit(True))
    hashed = F.concat(stem, F.lit("_"), F.substring(digest, 1, 10), ending)
    return df.join(taken, name, "left").withColumn("target", F.when(F.col("_taken"), hashed).otherwise(F.col(name))).drop("_taken")


def write_routed(df: DataFrame, status: str, path: str) -> None:
    """Rows in one folder per status, such as accepted and quarantine."""
    df.write.mode("overwrite").partitionBy(status).json(path)
