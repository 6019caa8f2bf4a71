"""Line deduplication and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from quillspan.llm.line_dedup import keep_bitmaps, kept_text
from quillspan.llm.ngram_join import HASHES, common_counts, components, jaccard_classes, least_matches, minhash, similar_to, spanning_edges, unpruned, verified

LONG = "This line is long enough to count as a key of the table %d"


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    docs: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                docs.setdefault(key(line), set()).add(i)
    keep = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keep.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [rng.choice([LONG % rng.randint(0, 9), (LONG % rng.randint(0, 9)).upper() + " \t", "short", "", f"É line of its own number {i} that is long enough {rng.random()}"]) for _ in range(rng.randint(1, 40))]
        rows.append((i, "\n".join(lines)))
    rows += [(59, rows[59][1]), (7, LONG % 1), (None, LONG % 1), (100, None), (101, ""), (102, "\n" * 20), (103, "\n".join([LONG % 2] * 3000))]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, _doc string, pos int")
    marked = keep_bitmaps(df)
    assert {"_doc", "pos"} <= set(marked.columns)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in marked.select("doc_id", "n_lines", "n_dropped", kept_text(F.col("text"), F.col("keep_bitmap")).alias("kept")).collect()]
    assert sorted(got, key=str) == brute_lines(rows)
    assert keep_bitmaps(df.limit(0)).count() == 0


def test_bitmaps_are_run_lengths(spark):
    """Runs of every width, read back to the lines that stay."""
    long = [f"line {i}" for i in range(20_000)]
    many = "\n".join([LONG % 1] * 3 + long[:100] + [LONG % 1] * 70 + long + [LONG % 1] + long[:5])
    rows = [(i, LONG % 1) for i in range(5)] + [(5, many), (9, LONG % 1)]
    got = {r.doc_id: (bytes(r.keep_bitmap) if r.keep_bitmap is not None else None, r.kept) for r in keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_bitmap", kept_text(F.col("text"), F.col("keep_bitmap")).alias("kept")).collect()}
    want = bytes([0, 3, 0x40, 100, 0x40, 70]) + (20_000 + (1 << 31)).to_bytes(4, "big") + bytes([1])
    assert got[5] == (want, "\n".join(long[:100] + long + long[:5]))
    assert got[0] == (bytes([0, 1]), "") and got[9] == (None, LONG % 1)


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    s = [shingles(t) if i is not None else set() for i, t in rows]
    link = [[a != b and s[a] and s[b] and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]) for b in range(len(rows))] for a in range(len(rows))]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[a]] + [root[b] for b in range(len(rows)) if link[a][b]]) for a in range(len(rows))]
        if new == root:
            break
        root = new
    least = {r: min(rows[a][0] for a in range(len(rows)) if root[a] == r) for r in set(root) if rows[r][0] is not None}
    return sorted(((i, least.get(root[a]) if i is not None else None, sum(map(bool, link[a]))) for a, (i, _) in enumerate(rows)), key=str)


def test_join(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(8):
        words = [word() for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3 % 101, " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(90))) for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "two words"), (304, "two  words"), (None, rows[0][1]), (305, rows[0][1]), (305, rows[0][1]), (306, "w " * 20000), (307, "w " * 19990)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df).collect()), key=str)
    assert got == brute_classes(rows)
    assert jaccard_classes(df.limit(0)).count() == 0


def test_pruning_and_edges():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 65536, HASHES).astype(np.uint16)
    near = one.copy()
    near[::8] += 1
    far = rng.integers(0, 65536, HASHES).astype(np.uint16)
    sigs = np.stack([one, far, near])
    assert similar_to(one, sigs).tolist() == [0, 2]
    assert spanning_edges(np.array([10, 11, 12]), sigs) == [(10, 12)]
    assert least_matches()[-1][0] == HASHES and all(0 <= m <= n for n, m in least_matches())


def test_unpruned_pairs_and_exact_counts():
    rng = np.random.default_rng(14)
    base = np.unique(rng.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = []
    for i in range(40):
        own = rng.integers(0, 1 << 60, int(rng.integers(0, 90)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate((base[rng.random(len(base)) > 0.1 * (i % 3)], own))) if i % 8 else np.unique(own))
    sets = [x if len(x) else base[:1] for x in sets]
    sigs, side = np.stack([minhash(x) for x in sets]), np.arange(40) % 2
    every = np.array([(a, b) for a in range(40) for b in range(a + 1, 40)])
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in every]
    assert common_counts(sets, every).tolist() == want
    assert common_counts(sets, every[:5]).tolist() == want[:5]
    near = {(a, b) for (a, b), n in zip(every.tolist(), want, strict=True) if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)}
    left = unpruned(sigs, np.zeros(40, int))
    assert near and len(left) < len(every) and near <= set(map(tuple, left.tolist()))
    assert set(map(tuple, verified(sets, left).tolist())) == near
    assert all(side[a] != side[b] for a, b in unpruned(sigs, side).tolist())


def test_recall_on_the_given_documents(spark):
    """Every pair at the threshold is found: exact similarities of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in jaccard_classes(docs).collect()}
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders: dict = {}
    for i, s in texts.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common: dict = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = dict.fromkeys(texts, 0)
    for (a, b), n in common.items():
        if 10 * n >= 8 * (len(texts[a]) + len(texts[b]) - n):
            links[a] += 1
            links[b] += 1
            assert found[a].class_id == found[b].class_id and found[a].class_key == found[b].class_key
    assert sum(links.values()) > 100 and {i: r.n_links for i, r in found.items()} == links


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 30), (50, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 40: 30}
