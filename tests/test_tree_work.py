"""What trees ask of tasks: bins cut column by column, sums that count rows, walks over rows of any order."""

import numpy as np

from tidemark.operators import trees


def _exact(x, bins):
    x = np.sort(x[~np.isnan(x)])
    at = np.ceil(np.arange(1, bins) / bins * len(x)).astype(int) - 1
    return np.unique(x[at][x[at] < x[-1]]) if len(x) else x


def _frame(spark, x, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(x.shape[1]))).repartition(parts)


def test_edges_are_exact_quantiles_of_few_rows_however_dealt(spark, monkeypatch):
    """Approximate ones depended on partitions, and one task put all columns' together."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), np.full(3000, np.nan), np.full(3000, 2.0), rng.normal(size=3000)])
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0, 4], x[1, 4] = np.inf, -np.inf
    names = [f"c{j}" for j in range(5)]
    for parts, points, cells in ((1, 20_000, 1 << 24), (7, 20_000, 1 << 24), (3, 500, 2500)):
        monkeypatch.setattr(trees, "POINTS", points)
        monkeypatch.setattr(trees, "CUT_CELLS", cells)
        got = trees.edges(_frame(spark, x, parts), names)
        assert [g.tolist() for g in got] == [_exact(x[:, j], trees.BINS).tolist() for j in range(5)], parts

    monkeypatch.setattr(trees, "POINTS", 100)
    monkeypatch.setattr(trees, "CUT_CELLS", 1)
    got = trees.edges(_frame(spark, x, 2), names)[0]
    known = np.sort(x[~np.isnan(x[:, 0]), 0])
    ranks = np.searchsorted(known, got, side="right") - np.ceil(np.arange(1, trees.BINS) / trees.BINS * len(known))
    assert len(got) == trees.BINS - 1 and np.abs(ranks).max() <= len(known) / 100 + 1


def test_one_sum_tells_residuals_and_rows():
    rng = np.random.default_rng(1)
    for size in (1 << 20, 1 << 40):  # the larger ones do not fit beside a count
        own, slot = rng.integers(0, 8, (3, 500)).astype(np.uint8), rng.integers(0, 4, 500)
        r = rng.integers(-size, size, 500).astype(float)
        sums, rows = trees._histograms(own, slot, r, 4, 7)
        assert sums.shape == rows.shape == (3, 4, 8)
        for j in range(3):
            for s in range(4):
                for b in range(8):
                    at = (own[j] == b) & (slot == s)
                    assert (sums[j, s, b], rows[j, s, b]) == (int(r[at].sum()), at.sum())
    n = trees.ROWS  # as many equal bins as there may be
    sums, rows = trees._histograms(np.zeros((1, n), np.uint8), np.zeros(n, int), np.full(n, -3.0), 1, 1)
    assert (sums[0, 0, 0], rows[0, 0, 0]) == (-3 * n, n)
