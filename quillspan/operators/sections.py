"""Section headings and their canonical types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import heading_key_of, normalize_heading

#: Canonical type, its parents, and its headings, in order of precedence.
ONTOLOGY = (
    ("ABSTRACT", (), ("tóm tắt", "abstract", "summary")),
    ("GRAPHICAL_ABSTRACT", (), ("graphical abstract",)),
    ("KEYWORDS", (), ("từ khóa", "keywords", "key words")),
    ("INTRODUCTION", (), ("đặt vấn đề", "mở đầu", "giới thiệu", "introduction")),
    ("BACKGROUND", ("INTRODUCTION",), ("bối cảnh", "background")),
    ("OBJECTIVES", ("INTRODUCTION",), ("mục tiêu", "objective", "objectives", "aims")),
    ("METHODS", (), ("đối tượng và phương pháp", "phương pháp nghiên cứu", "phương pháp", "materials and methods", "patients and methods", "methods")),
    ("STUDY_POPULATION", ("METHODS",), ("đối tượng nghiên cứu", "study population", "participants")),
    ("INCLUSION_CRITERIA", ("STUDY_POPULATION", "METHODS"), ("tiêu chuẩn lựa chọn", "inclusion criteria")),
    ("EXCLUSION_CRITERIA", ("STUDY_POPULATION", "METHODS"), ("tiêu chuẩn loại trừ", "exclusion criteria")),
    ("STUDY_DESIGN", ("METHODS",), ("thiết kế nghiên cứu", "study design")),
    ("STUDY_TIME", ("METHODS",), ("thời gian nghiên cứu", "study period", "study time")),
    ("STUDY_LOCATION", ("METHODS",), ("địa điểm nghiên cứu", "study setting", "study location")),
    ("SAMPLE_SIZE", ("METHODS",), ("cỡ mẫu", "sample size")),
    ("SAMPLING", ("METHODS",), ("phương pháp chọn mẫu", "sampling")),
    ("DATA_COLLECTION", ("METHODS",), ("thu thập số liệu", "data collection")),
    ("STATISTICAL_ANALYSIS", ("METHODS",), ("xử lý số liệu", "phân tích số liệu", "statistical analysis", "data analysis")),
    ("ETHICS", ("METHODS",), ("đạo đức nghiên cứu", "ethics approval", "ethical approval")),
    ("RESULTS", (), ("kết quả", "kết quả nghiên cứu", "results")),
    ("PARTICIPANT_CHARACTERISTICS", ("RESULTS",), ("đặc điểm chung", "đặc điểm đối tượng", "participant characteristics")),
    ("DISCUSSION", (), ("bàn luận", "discussion")),
    ("RESULTS_DISCUSSION", (), ("kết quả và bàn luận", "results and discussion")),
    ("CONCLUSION", (), ("kết luận", "conclusion", "conclusions")),
    ("RECOMMENDATION", (), ("khuyến nghị", "kien nghi", "recommendation", "recommendations")),
    ("ACKNOWLEDGEMENT", (), ("lời cảm ơn", "acknowledgement", "acknowledgment", "acknowledgements", "acknowledgments")),
    ("FUNDING", (), ("kinh phí", "funding")),
    ("CONFLICT_OF_INTEREST", (), ("xung đột lợi ích", "conflict of interest", "conflict of interest statement", "competing interests")),
    ("DATA_AVAILABILITY", (), ("data availability", "availability of data and materials")),
    ("AUTHOR_CONTRIBUTIONS", (), ("author contributions", "credit authorship contribution statement")),
    ("SUPPLEMENTARY_DATA", (), ("supplementary data",)),
    ("REFERENCES", (), ("tài liệu tham khảo", "references", "bibliography")),
    ("THE_MONARCH_APPLICATION", (), ("the monarch application",)),
    ("ANALYSIS_TOOLS_POWERED_BY_MONARCH", (), ("analysis tools powered by monarch", "analysis tools power by monarch")),
    ("COMMUNITY_ENGAGEMENT", (), ("community engagement",)),
)


def aliases(spark: SparkSession) -> DataFrame:
    """One row per heading key: a table whose size is that of the ontology."""
    rows = [(heading_key_of(a), i, kind, list(parents), heading_key_of(a).split()) for i, (kind, parents, names) in enumerate(ONTOLOGY) for a in names]
    return spark.createDataFrame(rows, "alias string, ordinal int, canonical_type string, parents array<string>, alias_words array<string>")


def classify_sections(df: DataFrame, heading: str, parent: str | None = None) -> DataFrame:
    """Add canonical_type, confidence and decision.

    An equal heading key gives .99, or .91 where a parent is named and is not the type's; else the alias
    that shares most of its words, three quarters at least, gives .70 + .20 x share; else OTHER."""
    known = F.broadcast(aliases(df.sparkSession))
    keyed = df.withColumn("_key", normalize_heading(F.coalesce(F.col(heading), F.lit(""))))
    under = F.col(parent) if parent else F.lit("")
    table = known.groupBy().agg(F.collect_list(F.struct("ordinal", "alias", "alias_words", "canonical_type", "parents")).alias("_aliases"))
    rows = keyed.crossJoin(F.broadcast(table)).withColumn("_words", F.array_distinct(F.split("_key", " ")))
    share = lambda a: F.size(F.array_intersect(F.col("_words"), a["alias_words"])) / F.size(F.array_distinct(a["alias_words"]))
    scored = rows.withColumn("_best", F.array_max(F.transform("_aliases", lambda a: F.struct((a["alias"] == F.col("_key")).alias("same"), share(a).alias("share"), (-a["ordinal"]).alias("first"), a["canonical_type"].alias("kind"), a["parents"].alias("parents")))))
    b = F.col("_best")
    fits = (F.size(b["parents"]) == 0) | F.array_contains(b["parents"], under)
    kind = F.when(F.col("_key") == "", "UNKNOWN").when(b["same"] | (b["share"] >= 0.75), b["kind"]).otherwise("OTHER")
    confidence = F.when(F.col("_key") == "", 0.0).when(b["same"], F.when(fits, 0.99).otherwise(0.91)).when(b["share"] >= 0.75, F.round(0.70 + b["share"] * 0.20, 2)).otherwise(0.35)
    decision = F.when(F.col("_key") == "", "empty_heading").when(b["same"], "exact").when(b["share"] >= 0.75, "similar").otherwise("no_match")
    return scored.withColumns({"canonical_type": kind, "confidence": confidence, "decision": decision}).drop("_key", "_aliases", "_words", "_best")
