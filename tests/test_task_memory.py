"""What a Python task holds at once does not grow with the leaves or the members."""

import tracemalloc

import numpy as np

from driftleaf.operators.bounds import _Leaves
from driftleaf.operators.scan import _Best
from driftleaf.operators.tree import Nodes


def _peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _envelopes(rng, n, width):
    low, high = np.sort(rng.normal(size=(2, n * width)), axis=0)
    part = {"off": np.tile(np.arange(width) * 4, n), "len": np.full(n * width, 4), "min_mean": low, "max_mean": high,
            "min_std": low * 0 + 0.1, "max_std": low * 0 + 0.5}
    return part, np.tile(np.arange(width), n)


def test_bounds_of_many_nodes_are_taken_in_pieces(rng):
    nodes = object.__new__(Nodes)
    nodes.part, nodes.slot = _envelopes(rng, 1000, 16)
    nodes.width, nodes.start = np.full(1000, 16), np.arange(1000) * 16
    means, stds = rng.normal(size=(100, 16)), np.full((100, 16), 0.3)
    row, node = np.repeat(np.arange(100), 3000), np.tile(np.arange(1000), 300)
    lb, peak = _peak(lambda: nodes.bounds(means, stds, row, node))
    assert peak < 80, f"{peak} MB"
    for i in (0, 131_071, 299_999):
        at = slice(node[i] * 16, node[i] * 16 + 16)
        d = np.maximum(np.maximum(nodes.part["min_mean"][at] - means[row[i]], means[row[i]] - nodes.part["max_mean"][at]), 0)
        assert abs(lb[i] - np.sqrt(4 * (d * d).sum())) < 1e-12


def test_bounds_of_many_leaves_are_taken_in_pieces(rng):
    leaves = object.__new__(_Leaves)
    leaves.part, leaves.slot = _envelopes(rng, 20_000, 16)
    leaves.leaf_ids, leaves.starts = np.arange(20_000), np.arange(20_000) * 16
    leaves.segments = [(i * 4, 4) for i in range(16)]
    x = rng.normal(size=(20, 64))
    lb, peak = _peak(lambda: leaves.bounds(x))
    assert lb.shape == (20, 20_000) and peak < 40, f"{peak} MB"


def test_nearest_so_far_stay_few(rng):
    def work():
        best = _Best(5, per_leaf=False)
        for i in range(120):
            n = 10_000
            best.add(np.arange(n) % 100, np.full(n, i), np.arange(n) + i * n, rng.random(n))
        return best.drain(np.arange(100))

    out, peak = _peak(work)
    assert out.num_rows == 500 and peak < 60, f"{peak} MB"
    many = _Best(5, per_leaf=False)  # what stays is above the piece: sorted again only when it has doubled
    for i in range(40):
        many.add(np.arange(100_000), np.full(100_000, i), np.full(100_000, i), np.full(100_000, float(i)))
    assert many.kept == 500_000
    assert sorted(set(many.drain(np.arange(100_000)).column(2).to_pylist())) == [0, 1, 2, 3, 4]
