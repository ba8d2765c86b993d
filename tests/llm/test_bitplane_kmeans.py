import hashlib

import numpy as np
import pytest

from affinity.llm import bitplane_kmeans as bk

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, id long, distance double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, 0.5) for i, v in rows], SCHEMA)


def brute(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all():
            kept.append((i, np.array([int(x) for x in np.floor(256 * np.array(v, float))], object)))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), list(r[1])))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [int(((v - c) ** 2).sum()) for c in centroids]
            out.append((i, min(range(len(d)), key=lambda j: d[j]), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), g in zip(kept, got) if g[1] == j]
            if mine:
                centroids[j] = np.array([int(x) // len(mine) for x in sum(mine)], object)
    got = assign()
    total = sum(g[2] for g in got)
    return sorted(((-1 if i is None else i), j, d, sum(g[2] for g in got if g[1] == j), total,
                   hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in got)


def run(spark, rows, k=40, rounds=5):
    found = bk.cluster(table(spark, rows), k=k, rounds=rounds)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(tuple(-1 if c == "vec_id" and r[c] is None else r[c] for c in names) for r in found.collect())


def vectors(n, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    out = scale * rng.standard_normal((n, 64))
    out[n // 2:n // 2 + n // 3] = out[0]  # a hot vector
    return [(int(i), v.tolist()) for i, v in enumerate(out)]


@pytest.mark.parametrize("n,k,scale", [(300, 40, 0.2), (120, 7, 1000.0), (25, 40, 1e-3)])
def test_equals_brute_force(spark, n, k, scale):
    rows = vectors(n, scale=scale)
    assert run(spark, rows, k) == brute(rows, k, 5)


def test_awkward_rows(spark):
    good = vectors(30)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]),
           (105, [1.0] * 63 + [float("-inf")]), (106, [0.0] * 64), (106, [0.0] * 64), (0, good[3][1]), (None, good[5][1])]
    assert run(spark, good + bad, 4) == brute(good + bad, 4, 5)


def test_empty_and_too_large(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
    with pytest.raises(ValueError, match="bit planes"):
        run(spark, [(1, [1e300] + [0.0] * 63)])
    edge = [(1, [-2.0 ** 19] * 64), (2, [2.0 ** 19 - 1] * 64)]
    assert run(spark, edge, 1, 0) == brute(edge, 1, 0)


def test_planes_give_products_and_sums():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-300, 300, (50, 64)), rng.integers(-300, 300, (9, 64))
    px, pc = bk.pack(x, 10), bk.pack(c, 10)
    assert (bk.dots(px, pc) == x @ c.T).all()
    assert (bk.norms(px) == (x * x).sum(1)).all()
    group = rng.integers(0, 5, 50)
    assert (bk.unpack_sums(px, group, 6) == np.array([x[group == g].sum(0) for g in range(6)])).all()
