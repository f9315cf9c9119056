"""extra trees sum a level from rows in order of their nodes."""

from __future__ import annotations

from unittest import mock

import numpy as np
import pyarrow as pa

from featflow.operators import extra_trees as X

TREE = {"feature": [0, -1, 1, -1, -1], "cut": [0.4, None, 0.6, None, None], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1]}


def rows(n=400):
    rng = np.random.default_rng(5)
    x = rng.random((n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    return x, rng.integers(0, 2, n).astype(float)


def test_a_level_is_one_step_of_all_rows():
    x, _ = rows()
    tree = X._arrays(TREE)
    assert tree["depth"] == 2
    want = [1 if a <= 0.4 else 3 if b <= 0.6 else 4 for a, b, _ in x]
    assert X.route(x, tree).tolist() == want == X.route(np.asfortranarray(x), tree).tolist()


def test_level_sums_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(X, "TaskContext", mock.Mock(**{"get.return_value.partitionId.return_value": 0}))
    x, y = rows()
    tree, node = X._arrays(TREE), X.route(x, X._arrays(TREE))
    open_ = {"nodes": np.array([4, 1]), "features": np.array([[0, 2], [1, 2]])}             # node 3 is closed
    cuts = np.array([[0.7, 0.5], [0.2, 0.9]])
    for w in (np.ones(len(x)), np.random.default_rng(6).random(len(x))):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[at].tolist(), pa.list_(pa.float64())), pa.array(y[at]), pa.array(w[at])], names=["x", "y", "w"])
                   for at in (slice(0, 150), slice(150, 400))]
        low, left = (np.frombuffer(next(X._level(iter(batches), [tree], [open_], c)).column("sums")[0].as_py()).reshape(2, 2, d)
                     for c, d in ((None, 2), ([cuts], 3)))
        for i, n in enumerate(open_["nodes"]):
            for j, f in enumerate(open_["features"][i]):
                v, own, weight = x[node == n, f], y[node == n], w[node == n]
                assert low[i, j].tolist() == [np.nanmin(v), -np.nanmax(v)]
                goes = v <= cuts[i, j]
                assert np.allclose(left[i, j], [(weight * (1 - own))[goes].sum(), (weight * own)[goes].sum(), goes.sum()])
