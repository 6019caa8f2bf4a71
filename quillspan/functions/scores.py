"""Scores of candidates and spans as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of a match by its method.
METHOD_CONFIDENCE = {"exact": 1.0, "alias": 0.98, "clinical_form": 0.97, "accentless": 0.94}
OTHER_CONFIDENCE = 0.96


def method_confidence(method: Column) -> Column:
    out = F.lit(OTHER_CONFIDENCE)
    for name, value in METHOD_CONFIDENCE.items():
        out = F.when(method == name, value).otherwise(out)
    return out


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    common = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    union = (a_end - a_start) + (b_end - b_start) - common
    return F.when(union <= 0, 0.0).otherwise(common / union)


def alias_confidence(boundary: Column, documents: Column, context: Column, information: Column) -> Column:
    """min(.99, .55 + .15 b + .15 min(1, df / 3) + .10 c + .05 min(1, max(0, mi) / 5))."""
    one = F.lit(1.0)
    score = 0.55 + 0.15 * boundary + 0.15 * F.least(one, documents / 3) + 0.10 * context + 0.05 * F.least(one, F.greatest(F.lit(0.0), information) / 5)
    return F.least(F.lit(0.99), score)


def alias_priority(confidence: Column, documents: Column) -> Column:
    return 0.6 * (1 - confidence) + 0.4 * F.least(F.lit(1.0), documents / 5)


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box a that box b covers; boxes are x0, y0, x1, y1."""
    wide = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    high = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area <= 0, 0.0).otherwise(wide * high / area)
