"""Admission of documents by the share of a language over fixed-size chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks


@dataclass(frozen=True)
class Gate:
    """Thresholds, and the evidence of a target language and of the one to reject."""

    target: str = "vi"
    other: str = "en"
    marks: str = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
    words: tuple[str, ...] = ()
    other_words: tuple[str, ...] = ()
    chunk_chars: int = 1200
    min_chars: int = 400
    min_target: float = 0.72
    min_other: float = 0.65


def signals(low: Column, words: Column, gate: Gate, p_target: Column, p_other: Column) -> tuple[Column, Column]:
    """Evidence of both languages in one chunk in lower case with its runs of letters, given a model's
    probabilities.

    Marks add up to 0.28 and marker words up to 0.24, so neither decides alone."""
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    marks = F.length(low) - F.length(F.translate(low, gate.marks, ""))
    known = lambda ws: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]).cast("array<string>")))
    marked = F.least(F.lit(0.28), marks / F.greatest(letters, F.lit(1)) * 4.0)
    target = F.least(F.lit(1.0), p_target * 0.72 + marked + F.least(F.lit(0.24), known(gate.words) * 0.035))
    other = F.least(F.lit(1.0), p_other * 0.76 + F.least(F.lit(0.24), known(gate.other_words) * 0.035))
    return target, other


def chunk_label(target: Column, other: Column, gate: Gate) -> Column:
    return F.when((target >= 0.52) & (target >= other + 0.08), gate.target).when((other >= 0.58) & (other >= target + 0.10), gate.other).otherwise("unknown")


def assess(df: DataFrame, gate: Gate, text: str = "text", p_target: Column | None = None, p_other: Column | None = None) -> DataFrame:
    """Add assessed_chars, target_ratio, other_ratio, language, reason and status.

    Everything happens inside the row's chunk array: nothing is exploded or shuffled."""
    p_target, p_other = p_target if p_target is not None else F.lit(0.0), p_other if p_other is not None else F.lit(0.0)

    def one(x: Column) -> Column:
        target, other = signals(x["low"], x["words"], gate, p_target, p_other)
        return F.struct(x["n"].alias("n"), chunk_label(target, other, gate).alias("label"))

    # each step keeps what the next one uses several times: the letters of a chunk are cut once
    lowered = F.transform(chunks(F.col(text), gate.chunk_chars), lambda c: F.struct(F.length(c).alias("n"), F.lower(c).alias("low")))
    cut = F.transform(lowered, lambda x: F.struct(x["n"].alias("n"), x["low"].alias("low"), F.regexp_extract_all(x["low"], F.lit(r"(\p{L}+)"), F.lit(1)).alias("words")))
    out = df.withColumn("_chunks", F.transform(cut, one))
    chars = lambda label: F.aggregate("_chunks", F.lit(0), lambda acc, c: acc + F.when(c["label"] == label, c["n"]).otherwise(0) if label else acc + c["n"])
    out = out.withColumns({"assessed_chars": chars(None), "_t": chars(gate.target), "_o": chars(gate.other)})
    share = lambda c: F.when(F.col("assessed_chars") > 0, F.col(c) / F.col("assessed_chars")).otherwise(0.0)
    out = out.withColumns({"target_ratio": share("_t"), "other_ratio": share("_o")})
    t, o = F.col("target_ratio"), F.col("other_ratio")
    out = out.withColumn("language", F.when(t >= gate.min_target, gate.target).when(o >= gate.min_other, gate.other).when((t > 0) | (o > 0), "mixed").otherwise("unknown"))
    reason = F.when(F.col("assessed_chars") == 0, "NO_TEXT").when(F.col("language") == gate.target, "TARGET_MAJORITY").when(F.col("language") == gate.other, "OTHER_MAJORITY").when(F.col("language") == "mixed", "MIXED_OR_INSUFFICIENT").otherwise("INSUFFICIENT_LANGUAGE_SIGNAL")
    status = F.when(F.col("assessed_chars") < gate.min_chars, "REJECTED_NO_TEXT").when(F.col("language") == gate.target, "ACCEPTED").when(F.col("language") == gate.other, "REJECTED_OTHER").otherwise("REJECTED_MIXED")
    return out.withColumns({"reason": reason, "status": status}).drop("_chunks", "_t", "_o")
