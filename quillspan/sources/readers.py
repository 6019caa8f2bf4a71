"""Readers: JSON lines, CoNLL, BRAT, verified artifacts, spreadsheets and binary documents.

Files are read by Spark, so any store that it reaches will do. Where line order matters a file is read
as one value and split with positions; order across partitions is never relied on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "struct<text:string,label:string,start:int,end:int>"
RECORD = f"id string, source string, source_split string, input_text string, entities array<{ENTITY}>, annotation_scope array<string>, is_partial_annotation boolean, checksum string"
MAX_PDF_BYTES = 50 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Strict: blank lines are skipped, a byte-order mark is allowed, a broken line fails the query."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """A broken line becomes a record with id __invalid_line_N (from 1, in its file) and parse_error."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    out = parsed.select("r.*", bad.alias("parse_error"), (F.col("pos") + 1).alias("_n"))
    return out.withColumn("id", F.when(F.col("parse_error"), F.concat(F.lit("__invalid_line_"), F.col("_n"))).otherwise(F.col("id"))).drop("_n", "_bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 0) and line of text files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return files.select("file", F.posexplode(F.split("value", r"\r?\n", -1)).alias("pos", "line"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence, pos, token, tag: the last column of a line is the tag, an empty line ends a sentence.

    A line of one column has the tag null and issue MISSING_TAG."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^﻿|\r", "").alias("value"))
    sentences = F.filter(F.split("value", r"\n\s*\n"), lambda s: F.trim(s) != "")
    rows = files.select("file", F.posexplode(sentences).alias("sentence", "body"))
    lines = rows.select("file", "sentence", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    whole = F.trim("line")
    two = whole.rlike(r"\s")
    token = F.when(two, F.regexp_extract(whole, r"^(.*\S)\s+\S+$", 1)).otherwise(whole)
    return lines.select("file", "sentence", "pos", token.alias("token"), F.when(two, F.regexp_extract(whole, r"(\S+)$", 1)).alias("tag"), F.when(~two, "MISSING_TAG").alias("issue"))


def parse_brat(text: str, ann: str, wanted: frozenset[str] | None, slack: int = 200) -> list[dict]:
    """Entities of a stand-off file. A span that does not hold its surface is looked for within `slack`
    characters, then in the whole text if it occurs there once; else it is an issue."""
    out = []
    for line in ann.splitlines():
        parts = line.split("\t")
        if not line.startswith("T") or len(parts) < 3:
            continue
        head, surface = parts[1].split(" ", 1), parts[2]
        row = {"text": surface, "label": head[0], "start": None, "end": None, "issue": None}
        out.append(row)
        if wanted is not None and head[0] not in wanted:
            row["issue"] = "OTHER_TYPE"
        elif len(head) < 2 or ";" in head[1]:
            row["issue"] = "DISCONTINUOUS"
        else:
            start, end = map(int, head[1].split())
            if text[start:end] != surface:
                near = text.find(surface, max(0, start - slack), end + slack)
                start = near if near >= 0 else text.find(surface) if text.count(surface) == 1 else -1
                end = start + len(surface)
            if start < 0:
                row["issue"] = "TEXT_MISMATCH"
            else:
                row["start"], row["end"] = start, end
    return out


def read_brat(spark: SparkSession, folder: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """stem, text and entities (with issue) of the .txt and .ann files of a folder, joined by stem."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[a-z]+$", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("stem"), F.col("value").alias("text"))
    notes = spark.read.text(f"{folder}/*.ann", wholetext=True).select(stem.alias("stem"), F.col("value").alias("ann"))

    @F.arrow_udf("array<struct<text:string,label:string,start:int,end:int,issue:string>>")
    def entities(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("issue", pa.string())]))
        for a, b in batches:
            yield pa.array([parse_brat(x or "", y or "", wanted) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return texts.join(notes, "stem").select("stem", "text", entities(F.col("text"), F.col("ann")).alias("entities"))


def verified_artifact(spark: SparkSession, path: str, sha256: str, count: int, entries: str) -> DataFrame:
    """The entries of a JSON artifact, after its checksum and count have been compared with the manifest.

    entries is the DDL of one entry; a difference raises ValueError."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.sha2("content", 256).alias("sha"), F.from_json(F.decode("content", "UTF-8"), f"version string, entries array<struct<{entries}>>").alias("r"))
    got = rows.select("sha", F.size("r.entries").alias("n")).first()
    if got is None or got["sha"] != sha256:
        raise ValueError(f"checksum of {path} is not that of the manifest")
    if got["n"] != count:
        raise ValueError(f"{path} has {got['n']} entries; the manifest says {count}")
    return rows.select("r.version", F.posexplode("r.entries").alias("ordinal", "e")).select("version", "ordinal", "e.*")


def read_legacy_csv(spark: SparkSession, path: str, renames: dict[str, str], keys: list[str]) -> DataFrame:
    """All columns as strings under their new names; of equal keys the first line stays."""
    df = spark.read.option("header", True).csv(path)
    for old, new in renames.items():
        df = df.withColumnRenamed(old, new)
    df = df.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    w = Window.partitionBy(*keys).orderBy("_at")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_at", "_n")


def read_excel(spark: SparkSession, path: str, sheet: str, header_row: int, required: list[str]) -> DataFrame:
    """A sheet as strings. Needs an Excel library next to pandas; raises ImportError without one."""
    import pandas as pd

    got = pd.read_excel(path, sheet_name=sheet, header=header_row, dtype=str)
    missing = [c for c in required if c not in got.columns]
    if missing:
        raise ValueError(f"columns missing in {sheet}: {missing}")
    return spark.createDataFrame(got.where(got.notna(), None))


def code_groups(rows: DataFrame, order: str, code: str, pattern: str = r"^650\d{4}$") -> DataFrame:
    """Add `group`: the code of the last anchor row at or above; rows above the first anchor go.

    Tables come as rows in order within one document (column `file`)."""
    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchor = F.when(F.trim(code).rlike(pattern), F.trim(code))
    return rows.withColumn("group", F.last(anchor, ignorenulls=True).over(w)).where("group IS NOT NULL")


def list_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", excluded: tuple[str, ...] = ("candidates", "quarantine")) -> DataFrame:
    """path, length, modificationTime and content of documents in all subfolders but the excluded ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    parts = "|".join(map(re.escape, excluded))
    return files.where(~F.col("path").rlike(f"/({parts})/")) if excluded else files


def pdf_checks(files: DataFrame) -> DataFrame:
    """Add `problem` (null if none): TOO_LARGE, EMPTY or NOT_PDF, and sha256, from the bytes alone."""
    magic = F.substring("content", 1, F.lit(4)) == F.lit(b"%PDF")
    problem = F.when(F.col("length") > MAX_PDF_BYTES, "TOO_LARGE").when(F.col("length") == 0, "EMPTY").when(~magic, "NOT_PDF")
    return files.withColumns({"problem": problem, "sha256": F.sha2("content", 256)})


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term and synonym rows of a JSON file that maps terms to lists."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return files.select(F.explode("m").alias("term", "list")).select("term", F.explode("list").alias("synonym"))


def snapshot(articles: DataFrame, n: int, text: str = "abstract") -> DataFrame:
    """The first n articles with text, by id, with a checksum."""
    return articles.where(F.col(text).isNotNull() & (F.trim(text) != "")).orderBy("id").limit(n).withColumn("checksum", F.sha2(text, 256))


def parse_entities(entities: Column, output_text: Column) -> Column:
    """Entities given as such, or as JSON text (fenced or not), or none."""
    body = F.regexp_replace(F.trim(output_text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    parsed = F.from_json(body, f"struct<entities:array<{ENTITY}>>")["entities"]
    return F.coalesce(entities, parsed, F.array().cast(f"array<{ENTITY}>"))
