"""One long document does not coarsen the bounds of the others."""

from quillspan.llm.packing import best_boundaries, length_buckets


def test_bounds_are_exact_beside_a_long_row(spark):
    lengths = [*range(20, 420), 1_000_000]
    counts = [1 + (7 * n) % 5 for n in lengths]
    rows = spark.createDataFrame([(n,) for n, c in zip(lengths, counts, strict=True) for _ in range(c)], "n long")
    assert length_buckets(rows, "n") == best_boundaries(lengths, counts, 16)
