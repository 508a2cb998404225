"""Vantage-point trees on vectors and leaves with which they do prune."""

import numpy as np

from spanweave.llm import vantage


def test_recall_with_pruning(monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[:, None] + 0.15 * rng.normal(size=(40, 50, 16))).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :10]
    tree, plain, done = vantage.Tree(ids, x, leaf=16), vantage.distances, []
    monkeypatch.setattr(vantage, "distances", lambda a, aa, b, bb: done.append(len(a) * len(b)) or plain(a, aa, b, bb))

    def search(factor):
        done.clear()
        best_d, best_i = np.full((len(x), 10), np.inf), np.full((len(x), 10), -1)
        tree.search(x, ids, 10, factor, best_d, best_i)
        assert sum(done) < 0.5 * len(x) ** 2  # it prunes
        print(factor, sum(done) / len(x) ** 2, (best_d <= want[:, -1:] + 1e-6).mean())
        return best_d

    assert np.allclose(search(1.0), want, atol=1e-6)
    assert (search(0.9) <= want[:, -1:] + 1e-6).mean() >= 0.9
