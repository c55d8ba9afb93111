"""Clusters against plain rounds over all distances, in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from casegraph.llm import clusters


def plain(rows, k=8, rounds=10, dim=4, scale=1024, seed=3):
    """rows of (vec_id, vector) that take part."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (away(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, where, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    d = [away(v, centroids[c]) for (_, v), c in zip(kept, where, strict=True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    per = [sum(x for x, c in zip(d, where, strict=True) if c == j) for j in range(len(centroids))]
    return sorted((i, c, fits(x) or 0, fits(per[c]) or 0, fits(sum(d)) or 0, names[c]) for (i, _), c, x in zip(kept, where, d, strict=True))


def rows(seed=1, n=300, spread=0.3):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((6, 4))
    x = [[float(v) for v in middle[i % 6] + spread * r.standard_normal(4)] for i in range(n)]
    out = list(enumerate(x))
    # ties, repeated rows, an id on two vectors, and rows that take no part
    out += [(1000 + i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)] + [out[5], out[5], (7, x[8]), (None, x[0]), (2000, None), (2001, []), (2002, [1.0]), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan"), 0.0, 0.0, 0.0]), (2005, [float("inf"), 0.0, 0.0, 0.0])]
    return out


def frame(spark, data):
    df = spark.createDataFrame([(i, v, 5, "x", 1) for i, v in data], "vec_id long, embedding array<double>, cluster int, distance string, nearest long")
    return df.repartition(3)


def result(df):
    return sorted(tuple(0 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 8, 40])
def test_equal_to_plain_rounds(spark, k):
    data = rows(k)
    assert result(clusters.centroid_clusters(frame(spark, data), k=k, dim=4, block_rows=64)) == plain(data, k=k)


def test_huge_and_mixed_components(spark):
    data = rows(9, 60) + [(3000 + i, [s * 1e30, 3.0, -1e18 * i, 2.0]) for i in range(8) for s in (1, -1)] + [(4000 + i, [1e300, -1e300 * i, 0.0, 1e-300]) for i in range(3)]
    assert result(clusters.centroid_clusters(frame(spark, data), dim=4, rounds=4, block_rows=32)) == plain(data, rounds=4)


def test_few_and_no_rows(spark):
    data = [(4, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, 2.0, 3.0, 4.0]), (6, [0.0, 0.0, 0.0, -0.001])]
    assert result(clusters.centroid_clusters(frame(spark, data), dim=4)) == plain(data)
    none = clusters.centroid_clusters(frame(spark, data).where("false"), dim=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_distances(spark):
    data = [r for r in rows(3, 3000, 0.05) if r[0] is not None and r[0] < 1000 or r[0] is not None and r[0] >= 3000]
    state, c, taken = clusters.cluster_rounds(frame(spark, data), k=40, dim=4)
    n = sum(len(r["ids"]) // 8 for r in state.select("ids").collect())
    assert taken[0] < 40 * n and sum(taken[3:]) < 0.3 * len(taken[3:]) * 40 * n


def test_search_equals_all_distances():
    r = np.random.default_rng(5)
    for _ in range(20):
        x = r.integers(-6, 7, (200, 3))
        c = clusters.Centroids(r.integers(-6, 7, (9, 3)).tolist())
        state = [r.integers(0, 9, 200).astype(np.int32)]
        state.append(((state[0] + 1 + r.integers(0, 8, 200)) % 9).astype(np.int32))
        upper, lower = np.full(200, np.inf), np.zeros(200)
        clusters.search(x, c, *state, upper, lower)
        d = ((x[:, None, :] - np.array(c.rows)[None]) ** 2).sum(axis=2)
        order = np.lexsort((np.broadcast_to(np.arange(9), d.shape), d), axis=1)
        assert (state[0] == order[:, 0]).all()
        first, then = (np.sqrt(np.take_along_axis(d, order[:, i : i + 1], 1))[:, 0] for i in (0, 1))
        searched = lower > 0  # others were settled by half the way to the next centroid
        assert np.allclose(upper, first) and np.allclose(lower[searched], then[searched])
        assert (d[np.arange(200), state[1]][searched] == np.rint(then[searched] ** 2)).all()


def test_blocks_survive_packing():
    for x in (np.array([[1, -2], [3, 40_000]]), np.array([[10**40, -(10**25)], [0, 7]], object), np.zeros((0, 2), np.int64)):
        assert clusters.unpack(*clusters.pack(x), 2).tolist() == x.tolist() if len(x) else True
