"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with one set of word shingles form one class from the start. MinHash bands bring candidates
together; within a band's bucket MinHash values are compared a few at a time, and a pair goes as soon as
the posterior probability that it reaches the threshold is below the tolerance. What is left connects
texts into clusters. A cluster is dealt to tiles of bounded size, as its number of links is wanted: in a
tile pairs are pruned by the same rule, and those left are verified exactly on their shingle sets. Pairs
never become rows: tiles return link counts and spanning edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .quality import window_hashes, word_hashes

#: Words in a shingle and the similarity that makes a link.
SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 4 values: two texts at the threshold share no band with probability (1 - 0.8^4)^32 < 5e-8.
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 16, 1e-7
#: Texts in a block of a bucket, and texts and shingles in a block of a cluster; a tile has two blocks.
BUCKET_BLOCK, TILE_TEXTS, TILE_SHINGLES = 1024, 512, 400_000
#: Bytes of text that a worker hashes at a time.
BATCH_BYTES = 8 << 20

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words (split at ASCII white space).

    A text of fewer words is one shingle; one without words has none."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words)))) + np.uint64(min(width, len(words)))


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits; equal with probability Jaccard (+ 2^-16)."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 1024):
        v = (x[None, i : i + 1024] ^ _B[:, None]) * _A[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(least, v.min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


_SIGNATURE = pa.struct([("ckey", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary())])


def signature(text: Column) -> Column:
    """ckey (128-bit hash of the shingle set), n_shingles and sig (MinHash values) of a text.

    All null for a text without words."""

    @F.arrow_udf("struct<ckey:binary,n_shingles:bigint,sig:binary>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, counts, sigs = [], [], []
            for data in batch.cast(pa.binary()):
                s = shingles(data.as_py() or b"")
                some = len(s) > 0
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if some else None)
                counts.append(len(s) if some else None)
                sigs.append(minhash(s).tobytes() if some else None)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())], fields=list(_SIGNATURE))

    return sign(text)


def shingle_hashes(text: Column) -> Column:
    """The sorted shingle hashes of a text as bytes, so that no tile hashes a text again."""

    @F.arrow_udf("binary")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data = batch.cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
            for a, b in slices(len(data), sizes, BATCH_BYTES):
                yield pa.array([shingles(x.as_py() or b"").tobytes() for x in data[a:b]], pa.binary())

    return hashes(text)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, matches a pair must have) after each step.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def similar_to(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the signatures whose pair with `one` is not pruned."""
    alive = np.arange(len(others))
    matches = np.zeros(len(others), np.int64)
    for n, least in least_matches():
        matches = matches + (others[alive, n - STEP : n] == one[n - STEP : n]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def spanning_edges(nodes: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what unpruned pairs connect: each text is compared with those not yet reached."""
    left, edges = np.arange(len(nodes)), []
    while len(left) > 1:
        root, todo = left[0], [left[0]]
        left = left[1:]
        while todo and len(left):
            at = todo.pop()
            found = similar_to(sigs[at], sigs[left])
            new = left[found]
            edges += [(int(nodes[root]), int(nodes[k])) for k in new]
            todo += new.tolist()
            left = np.delete(left, found)
    return edges


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, out of batches sorted by the keys (long columns)."""
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = np.stack([table[k].to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[a])
            if kept and key != last:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(table.slice(a, b - a))
            last = key
    if kept:
        yield pa.concat_tables(kept)


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    out: list[tuple[int, int]] = []
    for run in _runs(batches, ["g1", "g2", "tile"]):
        sigs = np.frombuffer(b"".join(run["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        out += spanning_edges(run["node"].to_numpy(), sigs)
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)


def unpruned(sigs: np.ndarray, side: np.ndarray) -> np.ndarray:
    """(i, j) rows, i < j, of the pairs of a tile that pruning leaves.

    side tells a text's block; in a tile of two blocks only pairs across them count."""
    across, out = side.max() != side.min(), []
    for i in range(len(sigs) - 1):
        others = np.arange(i + 1, len(sigs))
        if across:
            others = others[side[others] != side[i]]
        found = others[similar_to(sigs[i], sigs[others])]
        out.append(np.stack((np.full(len(found), i), found), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def common_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Shingles in common of each pair of sorted sets: pair by pair where pairs are few, else as products
    of 0/1 matrices over the shingles that several sets hold. Counts are exact whole numbers."""
    used, pairs = np.unique(pairs, return_inverse=True)
    pairs, sets = pairs.reshape(-1, 2), [sets[i] for i in used]
    n = len(sets)
    if len(pairs) < 4 * n:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs], np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    cols, rows = column[place[use]], owner[use]
    order = np.argsort(cols, kind="stable")
    cols, rows = cols[order], rows[order]
    common = np.zeros((n, n))
    width = max(256, (8 << 20) // (4 * n))  # below 2^24, so that each product is exact
    bounds = np.searchsorted(cols, np.arange(0, (cols[-1] if len(cols) else 0) + width, width))
    for k, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(cols)], strict=True)):
        if b > a:
            x = np.zeros((n, width), np.float32)
            x[rows[a:b], cols[a:b] - k * width] = 1
            common += x @ x.T
    return common[pairs[:, 0], pairs[:, 1]]


def verified(sets: list[np.ndarray], pairs: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Those of the pairs whose Jaccard similarity reaches the threshold, compared as whole numbers."""
    if not len(pairs):
        return pairs
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets, pairs)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common
    return pairs[np.round(common * 1_000_000) >= np.round(threshold * 1_000_000) * union]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile: rows (a, null, links, doc_links) and spanning edges (a, b, 0, 0)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("doc_links", pa.int64())])
    for run in _runs(batches, ["cluster", "low", "high"]):
        if run.num_rows < 2:
            continue
        nodes, side, copies = (run[c].to_numpy() for c in ("node", "block", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in run["hashes"].to_pylist()]
        sigs = np.frombuffer(b"".join(run["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        linked = verified(sets, unpruned(sigs, side))
        if not len(linked):
            continue
        both = np.concatenate((linked, linked[:, ::-1]))
        links = np.bincount(both[:, 0], minlength=len(nodes))
        doc_links = np.bincount(both[:, 0], copies[both[:, 1]].astype(np.float64), minlength=len(nodes)).astype(np.int64)
        out = [(nodes[i], None, int(links[i]), int(doc_links[i])) for i in np.flatnonzero(links)]
        root = np.arange(len(nodes))  # union by the least place
        for a, b in linked.tolist():
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((nodes[a], nodes[b], 0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component), for edges (a, b) of longs.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same. A
    node's least neighbour is aggregated before the shuffle, so a hub is no hot group; the join back to
    its edges is one that adaptive execution splits. Each round is a reliable checkpoint."""
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        downs = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(downs, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(downs.select("a", F.col("m").alias("b")))
        now = checkpoint(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _blocks(count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count)).cast("int")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the pairs in one bucket that are not pruned."""
    bucket = lambda i: F.xxhash64(i, F.substring("sig", i * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS)))
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), bucket)).alias("bucket"))
    sets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("g1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("g2")).where("n > 1")
    # buckets of the same texts are one: the two hashes name the set
    members = bands.join(sets, "bucket").select("g1", "g2", "n", "node").distinct()
    members = members.withColumn("blocks", _blocks(F.col("n") / BUCKET_BLOCK))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = members.select("g1", "g2", "node", "blocks", block.alias("block"), other.alias("other"))
    tiles = tiles.select("g1", "g2", "node", (F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).alias("tile"))
    rows = tiles.join(nodes.select("node", "sig"), "node").repartition("g1", "g2", "tile").sortWithinPartitions("g1", "g2", "tile", "node")
    return rows.select("g1", "g2", "tile", "node", "sig").mapInArrow(_pruned, "a long, b long")


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, class_id, class_key, n_links, n_text_links, n_copies and text_hash (xxhash64 of the text).

    Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.
    class_id is the least key among the texts that links connect and class_key the hash of that row's
    shingle set (null for a text without words), which tells classes apart where different texts share
    a key; n_copies counts other rows with the same shingle set, n_text_links other shingle sets that
    are linked, n_links all other rows linked. A text of fewer than 5 words is one shingle. A text
    without words, null or empty, links to nothing and is a class alone. A row with a null key has a
    null class and no links. Repeated rows are copies. An empty table gives an empty result; other
    columns are left behind."""
    rows = checkpoint(df.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), signature(F.col(text)).alias("s")).select("id", "text_hash", "s.*"))
    sets = rows.where("id IS NOT NULL AND ckey IS NOT NULL").groupBy("ckey").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = rows.select(F.col("id").alias("rep"), F.col("ckey").alias("_ckey"), "text_hash", "n_shingles", "sig").dropDuplicates(["rep", "_ckey"])
    nodes = sets.join(first, (sets["ckey"] == first["_ckey"]) & (sets["rep"] == first["rep"])).select("ckey", sets["rep"], "text_hash", "copies", "n_shingles", "sig")
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))

    clusters = components(_candidates(nodes))
    placed = clusters.join(nodes, "node")
    spans = clusters.join(nodes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    placed = placed.join(spans, "root").withColumn("blocks", _blocks(F.greatest(F.col("n") / TILE_TEXTS, F.col("total") / TILE_SHINGLES)))
    placed = placed.select("node", "rep", "text_hash", "copies", "sig", F.col("root").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = df.select(F.col(key).alias("rep"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(placed, ["rep", "text_hash"])
    one = texts.dropDuplicates(["node"]).select("cluster", "blocks", "block", "node", "copies", "sig", shingle_hashes(F.col("text")).alias("hashes"))
    tiles = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    found = checkpoint(tiles.select("cluster", "low", "high", "node", "block", "copies", "sig", "hashes").mapInArrow(_tiles, "a long, b long, links long, doc_links long"))

    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = roots.join(nodes.select("node", "rep", "ckey"), "node")
    least = named.groupBy("root").agg(F.min(F.struct("rep", "ckey")).alias("first"))
    linked = named.drop("rep", "ckey").join(least, "root").join(links, F.col("node") == F.col("a")).select("node", "first", "links", "doc_links")
    known = nodes.select("ckey", "rep", "copies", "node").join(linked, "node", "left").drop("node")
    out = rows.select("id", "text_hash", "ckey").join(known.withColumnRenamed("ckey", "_ckey"), F.col("ckey") == F.col("_ckey"), "left")
    some = F.col("id").isNotNull()
    copies = F.when(some, F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long")
    more = lambda c: F.when(some, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long")
    class_id = F.when(some, F.coalesce("first.rep", "rep", "id"))
    class_key = F.when(some, F.xxhash64(F.coalesce("first.ckey", "ckey")))
    class_key = F.when(F.col("ckey").isNotNull(), class_key)
    return out.select(F.col("id").alias(key), class_id.alias("class_id"), class_key.alias("class_key"), (more("doc_links") + copies).alias("n_links"), more("links").alias("n_text_links"), copies.alias("n_copies"), "text_hash")
