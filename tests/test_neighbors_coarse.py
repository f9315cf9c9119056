"""Blocks are compared in single precision first; the rows found are the same at any scale."""

import numpy as np
import pytest

from featflow.operators import neighbors as NB


@pytest.mark.parametrize("scale,shift,k", [(1, 0, 1), (1, 0, 3), (1, 1000, 1), (1e-20, 0, 1), (1e17, 0, 2), (1, 1e8, 1)])
def test_blocks_in_single_precision_lose_no_neighbour(monkeypatch, scale, shift, k):
    rng = np.random.default_rng(5)
    p = np.r_[rng.random((300, 8)), np.round(rng.random((200, 8)) * 2), np.repeat(rng.random((20, 8)), 5, axis=0) + 1e-9] * scale + shift
    ids = rng.permutation(len(p))
    monkeypatch.setattr(NB, "BLOCK", 32)
    got = NB._search(p, ids, p, ids, k, p[::40], np.full(len(p), np.inf))
    found = sorted(zip(*(x.tolist() for x in got)), key=lambda r: (r[0], r[2], ids[r[1]]))
    wanted = []
    for i, v in enumerate(p):
        d = NB._measured(np.broadcast_to(v, p.shape), p)
        wanted += [(i, int(j), float(d[j])) for j in sorted((j for j in range(len(p)) if j != i), key=lambda j: (d[j], ids[j]))[:k]]
    assert found == wanted


def test_few_queries_are_compared_in_double_precision(monkeypatch):
    rng = np.random.default_rng(6)
    p, ids = rng.random((4096, 16)), np.arange(4096)
    monkeypatch.setattr(NB, "BLOCK", 256)
    looked, real = [], NB._Coarse.within

    def within(self, rows, a, b, limit):
        out = real(self, rows, a, b, limit)
        looked.append((len(rows), len(out)))
        return out

    monkeypatch.setattr(NB._Coarse, "within", within)
    NB._search(p, ids, p, ids, 1, p[:16], np.full(4096, np.inf))
    assert sum(n for _, n in looked) < sum(n for n, _ in looked) / 2
