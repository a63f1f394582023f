"""Cells of requests and the choice of the nearest rows in them."""

import numpy as np
import pytest
from facetrank.functions.arrays import distances
from facetrank.operators.cells import nearest
from facetrank.operators.ranking import CELL_REQUESTS, MOST_REQUESTS, cells_for


def test_cells_grow_before_they_multiply():
    assert cells_for(0, 1, 200) == cells_for(CELL_REQUESTS, 1, 200) == 1
    assert cells_for(10 * CELL_REQUESTS, 1, 200) == 10
    # 1.2 million requests and 7 blocks: 29 copies of a vector keep 200 tasks busy; it was 147.
    assert cells_for(1_200_000, 7, 200) == 29
    assert cells_for(7_200_000, 42, 200) == -(-7_200_000 // MOST_REQUESTS)
    assert cells_for(10, 2, 4, cell_requests=3) == 2


@pytest.mark.parametrize("kind", ["random", "copies", "near one", "huge", "odd"])
def test_preselection_loses_no_row(kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(3_000, 8)).astype(np.float32).astype(np.float64)
    q = r.normal(size=(70, 8))
    if kind == "copies":
        x = x[r.integers(0, 20, len(x))]
    if kind == "near one":
        x, q = 1 + 1e-4 * x, 1 + 1e-4 * q
    if kind == "huge":
        x = x * 1e25
    if kind == "odd":
        x[::7, 2], x[1::50, 1] = np.nan, np.inf
    codes, limits = r.permutation(len(x)), r.integers(1, 101, len(q))
    with np.errstate(invalid="ignore"):
        for query, k, (best, measured) in zip(q, limits, nearest(x, codes, q, limits)):
            exact = distances(x, query)
            expected = np.lexsort((codes, exact))[:k]
            assert best.tolist() == expected.tolist()
            assert np.array_equal(measured, exact[expected], equal_nan=True)
