"""Token counts by heap-and-linked-list byte-pair merging; no identifier is made."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo
from .piece_model import BPE, PieceModel


def merge(text: str, rank: dict[str, float]) -> tuple[int, list[int]]:
    """Merges made, and the length of the symbol that begins at each character (0: inside one).

    Symbols form a linked list over their first characters. The heap holds (rank, place, length)
    of adjacent pairs; an entry counts only while its pair still has that length."""
    n = len(text)
    size, before = [1] * n, list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, length = heappop(heap)
        left = size[i]
        right_at = i + left
        if not left or right_at >= n or left + size[right_at] != length:
            continue
        size[i], size[right_at] = length, 0
        merges += 1
        end = i + length
        if end < n:
            before[end] = i
            both = length + size[end]
            if (r := rank.get(text[i : i + both])) is not None:
                heappush(heap, (r, i, both))
        if (p := before[i]) >= 0:
            both = size[p] + length
            if (r := rank.get(text[p : p + both])) is not None:
                heappush(heap, (r, p, both))
    return merges, size


class TokenCounter:
    """Counts as the library counts, without begin, end or added special tokens.

    A count is initial symbols minus merges. A character outside the inventory that stays alone
    stands for its UTF-8 bytes (or for one unknown token, where the model has no byte pieces)."""

    def __init__(self, model: PieceModel, memo: int = 250_000):
        if model.kind != BPE:
            raise ValueError("byte-pair merging needs a byte-pair model")
        self.model, self._rank, self._find = model, model.rank(), model.chunk_pattern.findall
        self._memo, self._part_memo = Memo(self._parts, memo), Memo(self._chunk, memo)

    def _parts(self, chunk: str) -> int:
        return sum(map(self._part_memo.__getitem__, self.model.parts(chunk)))

    def _chunk(self, chunk: str) -> int:
        merges, size = merge(chunk, self._rank)
        symbols = len(chunk)
        if self.model.byte_fallback and not self.model.chars.issuperset(chunk):
            symbols += sum(len(c.encode()) - 1 for c, n in zip(chunk, size, strict=True) if n == 1 and c not in self.model.chars)
        return symbols - merges

    def count(self, text: str | None) -> int:
        return sum(map(self._memo.__getitem__, self._find(self.model.normalised(text)))) if text else 0


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(PieceModel.load(path))


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of a text as long; null and empty text have 0. The model file must be at this path on
    every executor (a package file or one shipped with the job)."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(model_path)
        for batch in batches:
            yield pa.array([counter.count(x) for x in batch.to_pylist()], pa.int64())

    return count(text)


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    Null text counts as empty. Rows are kept one for one, repeated rows too; an empty table gives an
    empty result; columns of these three names are replaced, all others stay. Texts of any length are
    counted whole: a chunk without a cut costs n log n."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("n_tokens", token_count(text, model_path))
    return out.withColumns({"n_bytes": F.octet_length(text).cast("long"), "over_limit": F.col("n_tokens") > limit})
