"""One-to-one matching of predicted and gold spans, error typing and metrics."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from .relational import safe_ratio

_PAIRS = pa.list_(pa.struct([("pred", pa.int32()), ("gold", pa.int32()), ("score", pa.float64())]))
_ERRORS = pa.list_(pa.struct([("type", pa.string()), ("pred", pa.int32()), ("gold", pa.int32()), ("score", pa.float64())]))


def overlap_ratio(a: dict, b: dict) -> float:
    common = min(a["end"], b["end"]) - max(a["start"], b["start"])
    return common / (max(a["end"], b["end"]) - min(a["start"], b["start"])) if common > 0 else 0.0


def near(pred: list[dict], gold: list[dict]) -> Iterator[tuple[int, int]]:
    """Index pairs of overlapping spans, in order.

    Gold spans are looked through from the last that starts before a prediction's end back to where all
    earlier ones end before its start, so a document costs its overlaps and not the product of its sides."""
    order = sorted(range(len(gold)), key=lambda j: (gold[j]["start"], gold[j]["end"]))
    starts = [gold[j]["start"] for j in order]
    reach = list(accumulate((gold[j]["end"] for j in order), max))
    for i, p in enumerate(pred):
        k = bisect_left(starts, p["end"]) - 1
        found = []
        while k >= 0 and reach[k] > p["start"]:
            if gold[order[k]]["end"] > p["start"]:
                found.append(order[k])
            k -= 1
        for j in sorted(found):
            yield i, j


def same_spans(pred: list[dict], gold: list[dict]) -> Iterator[tuple[int, int]]:
    """Index pairs with one start and end, in order."""
    by_span: dict[tuple[int, int], list[int]] = {}
    for j, g in enumerate(gold):
        by_span.setdefault((g["start"], g["end"]), []).append(j)
    for i, p in enumerate(pred):
        for j in by_span.get((p["start"], p["end"]), ()):
            yield i, j


def edges(pred: list[dict], gold: list[dict], relaxed: bool) -> list[tuple[float, int, int]]:
    """(score, prediction, gold) of pairs with one label that match: equal, or overlapping by half."""
    if not relaxed:
        return [(1.0, i, j) for i, j in same_spans(pred, gold) if pred[i]["label"] == gold[j]["label"]]
    scored = ((overlap_ratio(pred[i], gold[j]), i, j) for i, j in near(pred, gold) if pred[i]["label"] == gold[j]["label"])
    return [x for x in scored if x[0] >= 0.5]


def greedy(pred: list[dict], gold: list[dict], relaxed: bool = True) -> list[tuple[int, int, float]]:
    """Best score first; of equal scores the later prediction, then the later gold span."""
    used_p, used_g, out = set(), set(), []
    for score, i, j in sorted(edges(pred, gold, relaxed), reverse=True):
        if i not in used_p and j not in used_g:
            used_p.add(i), used_g.add(j)
            out.append((i, j, score))
    return out


def bipartite(pred: list[dict], gold: list[dict], relaxed: bool = True) -> list[tuple[int, int, float]]:
    """A matching of the largest size, by augmenting paths without recursion."""
    scores = {(i, j): s for s, i, j in edges(pred, gold, relaxed)}
    choices: dict[int, list[int]] = {}
    for i, j in sorted(scores):
        choices.setdefault(i, []).append(j)
    owner: dict[int, int] = {}
    mine: dict[int, int] = {}
    for i in choices:
        came, todo, end = {}, [(i, j) for j in choices[i]][::-1], None
        while todo and end is None:
            p, j = todo.pop()
            if j in came:
                continue
            came[j] = p
            if j not in owner:
                end = j
            else:
                todo += [(owner[j], k) for k in choices[owner[j]] if k not in came][::-1]
        while end is not None:
            p = came[end]
            before = mine.get(p)
            owner[end], mine[p] = p, end
            end = before if p != i else None
    return sorted((p, j, scores[p, j]) for j, p in owner.items())


def token_overlap(pred: list[dict], gold: list[dict]) -> list[tuple[int, int, float]]:
    """One-to-one by the size of the overlap, same label, any overlap."""
    found = [(min(pred[i]["end"], gold[j]["end"]) - max(pred[i]["start"], gold[j]["start"]), -i, -j) for i, j in near(pred, gold) if pred[i]["label"] == gold[j]["label"]]
    used_p, used_g, out = set(), set(), []
    for n, i, j in sorted(found, reverse=True):
        if -i not in used_p and -j not in used_g:
            used_p.add(-i), used_g.add(-j)
            out.append((-i, -j, float(n)))
    return out


MATCHERS = {"greedy": greedy, "bipartite": bipartite, "exact": lambda p, g: greedy(p, g, False), "token_overlap": token_overlap}


def match_spans(pred: Column, gold: Column, method: str = "greedy") -> Column:
    """Index pairs of two arrays of (start, end, label) by one of MATCHERS; null counts as empty."""

    @F.arrow_udf("array<struct<pred:int,gold:int,score:double>>")
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in bounded(batches):
            yield pa.array([[{"pred": i, "gold": j, "score": s} for i, j, s in MATCHERS[method](p or [], g or [])] for p, g in zip(a.to_pylist(), b.to_pylist(), strict=True)], _PAIRS)

    return match(pred, gold)


def errors_reusing_gold(pred: list[dict], gold: list[dict], relaxed: bool = True) -> list[dict]:
    """Each unmatched prediction takes its best overlapping unmatched gold span, which others may take too:
    BOUNDARY_ERROR if the labels agree, else LABEL_ERROR. What remains is FP or FN."""
    pairs = greedy(pred, gold, relaxed)
    used_p, used_g = {x[0] for x in pairs}, {x[1] for x in pairs}
    best: dict[int, tuple[float, int]] = {}
    for i, j in near(pred, gold):
        if i not in used_p and j not in used_g:
            best[i] = max(best.get(i, (0.0, -1)), (overlap_ratio(pred[i], gold[j]), j))
    out, claimed = [], {j for _, j in best.values()}
    for i in range(len(pred)):
        if i in best:
            score, j = best[i]
            out.append({"type": "BOUNDARY_ERROR" if pred[i]["label"] == gold[j]["label"] else "LABEL_ERROR", "pred": i, "gold": j, "score": score})
        elif i not in used_p:
            out.append({"type": "FP", "pred": i, "gold": None, "score": None})
    return out + [{"type": "FN", "pred": None, "gold": j, "score": None} for j in range(len(gold)) if j not in used_g and j not in claimed]


def _in_rounds(pred: list[dict], gold: list[dict], rounds: list[list[tuple[float, int, int, str]]]) -> list[dict]:
    """After exact matches, each round's (score, -prediction, -gold, type) from the highest on, each span once;
    what remains is FP or FN."""
    used_p, used_g = ({x[k] for x in greedy(pred, gold, False)} for k in (0, 1))
    out = []
    for found in rounds:
        for score, i, j, kind in sorted(found, reverse=True):
            if -i not in used_p and -j not in used_g:
                used_p.add(-i), used_g.add(-j)
                out.append({"type": kind, "pred": -i, "gold": -j, "score": score})
    out += [{"type": "FP", "pred": i, "gold": None, "score": None} for i in range(len(pred)) if i not in used_p]
    return out + [{"type": "FN", "pred": None, "gold": j, "score": None} for j in range(len(gold)) if j not in used_g]


def errors_consuming(pred: list[dict], gold: list[dict]) -> list[dict]:
    """After exact matches: same span with another label first, then the best overlap of one label; each
    gold span is used once. What remains is FP or FN."""
    same = [(1.0, -i, -j, "LABEL_ERROR") for i, j in same_spans(pred, gold) if pred[i]["label"] != gold[j]["label"]]
    close = [(overlap_ratio(pred[i], gold[j]), -i, -j, "BOUNDARY_ERROR") for i, j in near(pred, gold) if pred[i]["label"] == gold[j]["label"]]
    return _in_rounds(pred, gold, [same, close])


def errors_patterns(pred: list[dict], gold: list[dict]) -> list[dict]:
    """After exact matches: same span with another label first (LABEL_ERROR), then the best overlap of any
    labels (BOUNDARY_ERROR; of equal ones the later spans), each span once. What remains is FP or FN."""
    same = [(1.0, -i, -j, "LABEL_ERROR") for i, j in same_spans(pred, gold) if pred[i]["label"] != gold[j]["label"]]
    first = _in_rounds(pred, gold, [same])
    left_p, left_g = [e["pred"] for e in first if e["type"] == "FP"], [e["gold"] for e in first if e["type"] == "FN"]
    p, g = [pred[i] for i in left_p], [gold[j] for j in left_g]
    used_p, used_g, out = set(), set(), [e for e in first if e["type"] == "LABEL_ERROR"]
    for score, i, j in sorted(((overlap_ratio(p[i], g[j]), i, j) for i, j in near(p, g)), reverse=True):
        if i not in used_p and j not in used_g:
            used_p.add(i), used_g.add(j)
            out.append({"type": "BOUNDARY_ERROR", "pred": left_p[i], "gold": left_g[j], "score": score})
    out += [{"type": "FP", "pred": left_p[i], "gold": None, "score": None} for i in range(len(p)) if i not in used_p]
    return out + [{"type": "FN", "pred": None, "gold": left_g[j], "score": None} for j in range(len(g)) if j not in used_g]


def errors_global(pred: list[dict], gold: list[dict]) -> list[dict]:
    """After exact matches: all overlapping pairs by ratio, any label, each span once."""
    found = [(overlap_ratio(pred[i], gold[j]), -i, -j, "BOUNDARY_ERROR" if pred[i]["label"] == gold[j]["label"] else "LABEL_ERROR") for i, j in near(pred, gold)]
    return _in_rounds(pred, gold, [found])


TYPING = {"reusing_gold": errors_reusing_gold, "consuming": errors_consuming, "patterns": errors_patterns, "global": errors_global}


def type_errors(pred: Column, gold: Column, method: str = "reusing_gold") -> Column:
    """Errors of two arrays of (start, end, label) by one of TYPING."""

    @F.arrow_udf("array<struct<type:string,pred:int,gold:int,score:double>>")
    def errors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in bounded(batches):
            yield pa.array([TYPING[method](p or [], g or []) for p, g in zip(a.to_pylist(), b.to_pylist(), strict=True)], _ERRORS)

    return errors(pred, gold)


def exact_counts(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp and fn by label for multisets of spans keyed by `keys` (label among them).

    Equal spans pair off one to one, so tp of a key is the lesser of its two counts: two aggregations
    and one join, no matching."""
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("p"))
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    both = p.join(g, keys, "full_outer").fillna(0, ["p", "g"])
    tp = F.least("p", "g")
    return both.groupBy("label").agg(F.sum(tp).alias("tp"), F.sum(F.col("p") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows with tp, fp and fn; 0 where a denominator is."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn)})


def with_averages(per_label: DataFrame) -> DataFrame:
    """The labels' metrics with MICRO and MACRO rows."""
    micro = metrics(per_label.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])).withColumn("label", F.lit("MICRO"))
    macro = per_label.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).withColumn("label", F.lit("MACRO"))
    return per_label.unionByName(micro.select(per_label.columns)).unionByName(macro.select(per_label.columns))
