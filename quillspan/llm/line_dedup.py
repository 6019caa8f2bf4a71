"""Line deduplication with DataFrame functions only.

Hashes of long lines are range-partitioned and sorted by hash, document and position. A repeated
hash is led by a header row that names the document which keeps it, so one pass over the sorted rows
tells first occurrences from the rest. Headers come from counts that are aggregated before they are
shuffled; a hot hash is dealt to several salts, each with its own header. The result is a keep bitmap
per document, compressed to its run lengths, and null where nothing goes: texts are never shuffled by line.

A bitmap is the lengths of its runs, kept and dropped lines in turn, from a run of kept lines (of length 0
if the first line goes) to the last run of dropped ones; what follows is kept. A length below 2^6 takes one
byte, below 2^14 two and else four; the top two bits 0, 1 or 2 tell which, and the rest is the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, checkpoint
from .common import kept as kept_columns

#: White space stripped from lines, and the lines that count.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower_ascii(line: Column) -> Column:
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _occurrences(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """doc, th (hash of the text), pos and the 128-bit hash of each line that is long enough."""
    lines = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keys = lines.select("doc", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.length("line") >= min_chars)
    line = _lower_ascii(F.col("line"))
    return keys.select("doc", "th", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def repeated_lines(occurrences: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n_docs and keep_doc (the largest id) of each line key found in min_docs documents or more."""
    return occurrences.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keep_doc")).where(F.col("n_docs") >= min_docs)


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, th and pos of each line that goes.

    Lines are hashed once: counting, the sample for the ranges and ranging itself read the stored hashes."""
    spark = df.sparkSession
    occurrences = checkpoint(_occurrences(df, key, text, min_chars))
    repeated = checkpoint(repeated_lines(occurrences, min_docs))
    total = repeated.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    #: a hash in more documents than this is hot; at most 4 x partitions hashes can be
    share = max(1, total // (4 * parts))
    hot = repeated.where(F.col("n_docs") > share).select("h1", "h2", F.ceil(F.col("n_docs") / share).cast("int").alias("salts"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    headers = repeated.withColumn("salts", F.ceil(F.col("n_docs") / share).cast("int"))
    headers = headers.select("h1", "h2", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(df.schema[key].dataType).alias("doc"), F.lit(None).cast("long").alias("th"), F.lit(None).cast("int").alias("pos"), "keep_doc")
    rows = occurrences.join(F.broadcast(hot), ["h1", "h2"], "left")
    rows = rows.select("h1", "h2", F.pmod(F.xxhash64("doc"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc", "th", "pos", F.lit(None).cast(df.schema[key].dataType).alias("keep_doc"))
    ordered = headers.unionByName(rows).repartitionByRange(parts, "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("kind", F.col("doc").desc(), "th", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = ordered.withColumn("keeper", F.first("keep_doc").over(stream))
    return led.where((F.col("kind") == 1) & F.col("keeper").isNotNull() & (F.col("doc") != F.col("keeper"))).select("doc", "th", "pos")


def _length_code(n: Column) -> Column:
    """A run length in hexadecimal digits."""
    wide = n.cast("long")
    return F.when(wide < 1 << 6, F.lpad(F.hex(wide), 2, "0")).when(wide < 1 << 14, F.hex(wide + (1 << 14))).otherwise(F.hex(wide + (1 << 31)))


def _run_lengths(bitmap: Column) -> Column:
    """The run lengths in a bitmap: the first digit of a code tells its width."""
    codes = F.regexp_extract_all(F.hex(bitmap), F.lit("([0-3][0-9A-F]|[4-7][0-9A-F]{3}|[89AB][0-9A-F]{7})"), F.lit(1))
    base = lambda c: F.when(F.length(c) == 2, 0).when(F.length(c) == 4, 1 << 14).otherwise(F.lit(1 << 31))
    return F.transform(codes, lambda c: (F.conv(c, 16, 10).cast("long") - base(c)).cast("int"))


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Add n_lines, n_dropped and keep_bitmap (null: all lines stay) to every row.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of
    min_chars code points or more in min_docs documents or more lose all their lines but those in the
    largest id. Null or empty text is one empty line. A null id is no document: its row stays whole.
    Rows with one id count as one document and each is judged by its own text; repeated rows all get
    the same bitmap. An empty table gives an empty result; columns of these names are replaced."""
    drops = dropped_lines(df.select(key, text), key, text, min_chars, min_docs).groupBy("doc", F.col("th").alias("doc_th")).agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    rows = beside(df, F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("th")))
    out = rows.join(drops, (F.col("new.id") == F.col("doc")) & (F.col("new.th") == F.col("doc_th")), "left")
    n_lines = F.size(split_lines(F.col("row")[text]))
    n_dropped = F.coalesce(F.size("drops"), F.lit(0)).cast("long")
    d = F.col("drops")
    begins = F.filter(d, lambda p, i: (i == 0) | (F.get(d, i - 1) != p - 1))
    ends = F.filter(d, lambda p, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != p + 1))
    runs = out.withColumns({"begins": begins, "ends": ends})
    before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(-1))
    codes = F.transform("begins", lambda p, i: F.concat(_length_code(p - before(i) - 1), _length_code(F.get("ends", i) - p + 1)))
    bitmap = F.when(d.isNotNull(), F.unhex(F.array_join(codes, "")))
    return runs.select(*kept_columns(df, "n_lines", "n_dropped", "keep_bitmap"), n_lines.cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), bitmap.alias("keep_bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The kept lines, joined by line ends; all of the text (null: empty) without a bitmap."""
    flags = F.flatten(F.transform(_run_lengths(bitmap), lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.zip_with(split_lines(text), flags, lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.array_compact(kept), "\n"))
