"""Chat formatting, sharding and packing."""

import hashlib
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F
from quillspan.llm.chat_format import digest, escape, format_conversations, unescape
from quillspan.llm.packing import best_boundaries, pack
from quillspan.llm.sharding import assign_shards, equal_weights, rendezvous

NASTY = ["<|im_end|>", "<||", "<|", "|>", "<", "<|n|>", "<|||im_sep|>", "a\n<|im_start|>user\nb", "", None]


def test_chat_round_trip(spark):
    rows = [(c, t, role, NASTY[(c + t) % 10], "x") for c in range(10) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "user", "a\nb<|"])]
    rows += [(None, None, None, "lost", "x"), (1, 0, "system", NASTY[1], "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks string")
    got = {r.conv_id: r for r in digest(format_conversations(df)).collect()}
    by: dict = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.loss_mask_fits and r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digest(format_conversations(df.limit(0))).count() == 0


def test_chat_escape_is_reversible(spark):
    df = spark.createDataFrame([(x,) for x in NASTY if x is not None], "t string")
    assert all(r.t == r.b and "<|im" not in r.e for r in df.select("t", unescape(escape(F.col("t"))).alias("b"), escape(F.col("t")).alias("e")).collect())


def test_shards(spark):
    rows = [(i, f"text {i % 7}", "x") for i in range(3000)] + [(5, "text 5", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = assign_shards(df, "doc_id", 8).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.08 < moved < 0.15
    assert assign_shards(df.limit(0), "doc_id", 8).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(20000)
    weights = {0: 1.0, 1: 3.0, 2: 0.0}
    counts = Counter(r.s for r in ids.select(rendezvous([F.col("id")], weights).alias("s")).collect())
    assert counts[2] == 0 and 0.72 < counts[1] / 20000 < 0.78
    both = ids.select(rendezvous([F.col("id")], equal_weights(4)).alias("a"), rendezvous([F.col("id")], {0: 1.0, 1: 1.0, 3: 1.0}).alias("b"))
    assert both.where("a <> 2 AND a <> b").count() == 0


def padding(lengths, counts, uppers):
    return sum(c * (min(u for u in uppers if u >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    lengths, counts = [0, 1, 4, 5, 9, 20, 21, 40, 41], [3, 7, 1, 9, 2, 5, 1, 1, 8]
    for k in range(1, 6):
        got = best_boundaries(lengths, counts, k)
        least = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in combinations(lengths[:-1], n))
        assert len(got) <= k and padding(lengths, counts, got) == least
    assert best_boundaries([], [], 4) == [] and best_boundaries([7], [2], 4) == [7]


def test_packing(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), 1) for i in range(500)] + [(1, "w", 1), (None, None, 1), (9, "w " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    got = pack(df, buckets=4, budget=200).collect()
    assert len(got) == len(rows) and all(0 <= r.padding == r.bucket_tokens - r.n_tokens for r in got)
    batches = Counter((r.bucket, r.batch) for r in got)
    bound = {r.bucket: r.bucket_tokens for r in got}
    for b, upper in bound.items():
        per = max(1, 200 // max(upper, 1))
        sizes = [n for (bucket, _), n in sorted(batches.items()) if bucket == b]
        assert all(n == per for n in sizes[:-1]) and 1 <= sizes[-1] <= per
    assert pack(df.limit(0)).count() == 0
