"""The corpus pipeline: quality rules, language ID, line dedup, n-gram Jaccard join and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the folder named by spark.checkpoint.dir and reads them for the next one. All stages but the
last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import checkpoint, shared_folder, table
from quillspan.llm.language_id import UNKNOWN, identify, learn
from quillspan.llm.line_dedup import keep_bitmaps, kept_text
from quillspan.llm.ngram_join import jaccard_classes
from quillspan.llm.packing import pack
from quillspan.llm.quality import fit, quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The winning language must be more likely than all others together, and its cost nearer to that of its
#: labelled texts than to that of shuffled letters (see quillspan.llm.language_id).
MIN_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are anomalous go. The forest is fitted on labelled rows of docs.

    Null and empty texts have no words and go. A null key has a verdict by its text like any other;
    repeated rows share theirs. Without labels only the base rules decide. Texts are read whole. Further
    columns of docs are left behind; an empty table gives an empty result."""
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs.select(*COLUMNS), forest).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language for sure, go: gibberish and other scripts too.

    Null and empty texts go; so do all if no row has both text and lang. Rows with a null lang teach
    nothing and are judged by their text. Repeated rows share a verdict. Texts are parsed whole. Further
    columns of docs are left behind; an empty table gives an empty result."""
    parser = learn(docs, F.lit(True))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return identify(docs.select(*COLUMNS), parser).where(known).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one of largest id. No document goes; n_chars follows the text.

    A null text stays null, an empty one empty; a row with a null id stays whole. Rows that share an id
    are one document for the counts and each is cut by its own text. Further columns of docs are left
    behind; an empty table gives an empty result."""
    marked = keep_bitmaps(docs.select(*COLUMNS))
    text = F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep_bitmap")))
    return marked.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one of least id.

    Where several rows of a class have that id, one of them stays: that of least text hash, once.
    Different texts under one id are classes of their own. Texts without words (null, empty) are in no
    class and all stay; so do rows with a null id. Further columns of docs are left behind; an empty
    table gives an empty result."""
    classes = jaccard_classes(docs).where("doc_id IS NOT NULL AND class_key IS NOT NULL")
    going = classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id", "text_hash", F.lit("go").alias("verdict"))
    heads = classes.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id", "class_key", "text_hash").count()
    one = Window.partitionBy("doc_id", "class_key").orderBy("text_hash")
    verdict = F.when(F.row_number().over(one) > 1, "go").when(F.col("count") > 1, "once")
    marks = checkpoint(heads.select("doc_id", "text_hash", verdict.alias("verdict")).where("verdict IS NOT NULL").unionByName(going).distinct())
    judged = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text")).join(marks, ["doc_id", "text_hash"], "left")
    out = judged.where("verdict IS NULL")
    if not marks.where("verdict = 'once'").isEmpty():
        out = out.unionByName(judged.where("verdict = 'once'").dropDuplicates(["doc_id", "text_hash"]))
    return out.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place; no row goes.

    Null and empty texts have length 0. A null id is a value like others; repeated rows are packed each,
    ties are interchangeable. Texts are never cut. Other columns of docs are left behind; an empty table
    gives an empty result."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No SQL: the forest, the automata and the verified join can't be said in SQL. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
