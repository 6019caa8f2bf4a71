"""The registered queries of the ten operators, over whole small tables, against independent versions."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from quillspan.llm import queries as q
from quillspan.llm.packing import BUCKETS, TOKEN_BUDGET
from quillspan.llm.quality import IsolationForest, _usual_path
from test_dedup import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(q.PIECE_MODEL))


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_op1_and_op4(spark, docs, library):
    coded, counted = rows(q.op1_sentencepiece(spark, SF)), rows(q.op4_token_counts(spark, SF))
    assert set(coded) == set(counted) == set(docs)
    for i, t in docs.items():
        ids = library.encode(t)
        assert coded[i].ids == ids and coded[i].round_trip and coded[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 4096)


def test_op2(spark, docs):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in q.op2_ngram_jaccard(spark, SF).collect())
    assert got == sorted(brute_classes(list(docs.items())))


def test_op5(spark, docs):
    got = rows(q.op5_media_columns(spark, SF))
    for i, t in docs.items():
        data = t.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and r.feature.startswith("codec=raw;rate=8000;")
    assert len({(docs[i], got[i].media_sha256, got[i].feature) for i in docs}) == len(set(docs.values()))


def chosen_shard(key, n):
    """The least -ln(u) over the shards, u from the 64-bit hash of key and shard."""

    def score(s):
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        return -math.log(((h >> 11) + 0.5) / 2**53)

    return min(range(n), key=lambda s: (score(s), s))


def test_op6(spark, docs):
    got = rows(q.op6_sharding(spark, SF))
    for i, t in docs.items():
        r = got[i]
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key")
        assert (r.shard, r.grown_shard) == (chosen_shard(i, 8), chosen_shard(i, 9)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_op7_and_op8(spark, docs):
    import re

    quality, language = rows(q.op7_quality_rules(spark, SF)), rows(q.op8_language_id(spark, SF))
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (quality[i].n_words, quality[i].word_chars) == (len(words), sum(map(len, words)))
        assert quality[i].base_failed == (len(words) < 20 or 100 * quality[i].n_repeat_words > 30 * len(words)) and not (quality[i].base_failed and quality[i].kept)
        assert language[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= language[i].score <= 1
        assert (language[i].lang_pred == "und") == (not any(map(str.isalpha, t)))
    assert np.mean([language[i].lang_pred == truth[i] for i in docs if language[i].held_out and language[i].lang_pred != "und"]) > 0.95


def test_forest_scores_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(18)
    x = rng.normal(0, 1, (300, 4))
    forest = IsolationForest.fit(x, 0.1, trees=20)

    def walk(tree, row, node=0):
        feature, split, left, path = tree
        if feature[node] < 0:
            return path[node]
        return walk(tree, row, left[node] + (1 if row[feature[node]] > split[node] else 0))

    want = [2 ** -(np.mean([walk(t, row) for t in forest.trees]) / float(_usual_path(forest.rows))) for row in x]
    assert forest.score(x) == pytest.approx(want)


def test_op9(spark, docs):
    import re

    got = rows(q.op9_packing(spark, SF))
    lengths = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    assert {i: r.n_tokens for i, r in got.items()} == lengths
    # the least padding over all choices of bounds, by a table over every pair of distinct lengths
    sizes = sorted(set(lengths.values()))
    count = Counter(lengths.values())
    cost = [[0] * len(sizes) for _ in sizes]
    for a in range(len(sizes)):
        total = 0
        for b in range(a, len(sizes)):
            total += (sizes[b] - sizes[b - 1]) * sum(count[sizes[k]] for k in range(a, b)) if b > a else 0
            cost[a][b] = total
    best = cost[0][:]
    for _ in range(BUCKETS - 1):
        best = [min([best[b], *[best[k] + cost[k + 1][b] for k in range(b)]]) for b in range(len(sizes))]
    assert sum(r.padding for r in got.values()) == best[-1]
    per = {r.bucket: max(1, TOKEN_BUDGET // max(1, r.bucket_tokens)) for r in got.values()}
    for b, n in per.items():
        mine = sorted((r.batch, r.batch_slot) for r in got.values() if r.bucket == b)
        assert mine == [(k // n, k % n) for k in range(len(mine))]
