"""kNN over several groups of points and queries: bounded output, same rows as all pairs."""

from functools import reduce

import numpy as np
import pytest

from featflow.operators import neighbors as NB


@pytest.mark.parametrize("group_bytes", [2000, 1 << 20])
def test_knn_over_groups_equals_all_pairs(spark, group_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(150)] + [(i, [float(x) for x in 100 + rng.random(3)]) for i in range(150, 220)]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    got = {(r.qid, r.nn_rank): (r.sqdist, r.nn_id) for r in NB.knn(df, "id", "v", 4, n_pivots=5, group_bytes=group_bytes).collect()}
    assert len(got) == 4 * len(rows)
    for q, v in rows:
        near = sorted((reduce(lambda t, x: t + x * x, (a - b for a, b in zip(v, w)), 0.0), i) for i, w in rows if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == near


def test_a_point_group_returns_at_most_k_rows_a_query(monkeypatch):
    rng = np.random.default_rng(4)
    p, ids = np.repeat(rng.random((20, 6)), 30, axis=0), np.arange(600)
    monkeypatch.setattr(NB, "BLOCK", 64)
    row, point, d = NB._search(p, ids, p, ids, 3, p[::100], np.full(600, np.inf))
    assert np.bincount(row).tolist() == [3] * 600 and (row != point).all() and (d == 0).all()
    same = [sorted(j for j in ids[i // 30 * 30:i // 30 * 30 + 30] if j != i)[:3] for i in ids]
    assert [sorted(point[row == i].tolist()) for i in ids] == same
