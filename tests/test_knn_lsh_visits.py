"""Visits leave a task in bounded frames, whatever the number of queries in a batch and of leaves that each visits."""

import numpy as np
import pytest

from lexisieve.operators import knn_lsh


@pytest.mark.parametrize("most", [1, 7, 16, 99])
def test_frames_of_visits_are_bounded(monkeypatch, most):
    monkeypatch.setattr(knn_lsh, "_PROBE_ROWS", 40)
    rng = np.random.default_rng(3)
    tree, x = knn_lsh.Tree.fit(rng.normal(size=(400, 5)), 4, 1), rng.normal(size=(33, 5))
    frames = list(knn_lsh._visits_of(tree, x, most))
    assert max(len(rows) for rows, _, _ in frames) <= 40
    leaves, penalty = tree.probes(x, most)
    rows, got, sums = (np.concatenate(part) for part in zip(*frames))
    np.testing.assert_array_equal(rows, np.repeat(np.arange(33), leaves.shape[1]))
    np.testing.assert_array_equal(got, leaves.ravel())
    np.testing.assert_allclose(sums, penalty.ravel(), atol=1e-12)
