import numpy as np
import pytest

from lexisieve.llm import cells


@pytest.mark.parametrize("rank", [2, 4, 64])
def test_vectors_of_low_rank_keep_all_links(spark, rank):
    """64 dimensions, few effective ones: differences lie along the cells' normals."""
    pick = np.random.default_rng(rank)
    base = pick.normal(size=(800, rank))
    if rank == 64:
        base = np.repeat(base[:40], 20, axis=0) + pick.normal(scale=0.2, size=(800, rank))
    x = base @ np.linalg.qr(pick.normal(size=(64, rank)))[0].T
    cosine = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    linked = (cosine >= 0.95) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in cells.near_vectors(df, per_cell=20).collect()}
    assert [got[i] for i in range(len(x))] == linked.sum(1).tolist()
    assert linked.any()
