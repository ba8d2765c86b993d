import numpy as np
import pytest

from affinity.llm import cover_tree as ct

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, part int, id long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2, "v") for i, v, lab in rows], SCHEMA)


def brute(rows, every=10, positives=5, negatives=10):
    ok = {}
    for i, v, lab in rows:
        if None not in (i, v, lab) and None not in v and np.isfinite(v).all():
            r = (lab, [int(x) for x in np.floor(256 * np.array(v, float))])
            ok[i] = min(ok.get(i, r), r)
    out = []
    for a, (la, va) in ok.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in ok.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if ok[i][0] == la)[:positives]
        for ps, p in best:
            fit = sorted((-s, i) for i, s in score.items() if ok[i][0] != la and 30 * -ps <= 100 * s <= 90 * -ps)
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def run(spark, rows, every=10):
    got = ct.integer_rows(table(spark, rows))
    return sorted(map(tuple, ct.mine(got, got.where(f"id % {every} = 0")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, width=8, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    out = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, width))
    out *= rng.uniform(0.2, 2, (n, 1))
    out[n // 2:n // 2 + n // 3] = out[1]  # ties
    return [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(out)]


@pytest.mark.parametrize("tree_bytes,group,centres,leaf", [(8 << 20, 1024, 32, 64), (2_000, 7, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, tree_bytes, group, centres, leaf):
    monkeypatch.setattr(ct, "TREE_BYTES", tree_bytes)
    monkeypatch.setattr(ct, "GROUP_ROWS", group)
    monkeypatch.setattr(ct, "CENTRES", centres)
    monkeypatch.setattr(ct, "LEAF", leaf)
    rows = vectors(400)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = vectors(60, width=4)
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")], 0), (230, [1.0], None), (None, [1.0], 1),
             (240, [], 1), (250, [1.5], 1), (260, [0.0] * 4, 2), (260, [0.5] * 4, 1), (270, [-3.0] * 6, 0), (280, [2.0] * 4, 99)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables_and_large_scores(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, None, 1)]) == []
    assert run(spark, [(10, [1.0], 1)]) == []
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(10, [1e16] * 3, 1), (20, [1e16] * 3, 1), (21, [1e16] * 3, 2)])


def test_tree_covers_its_points_and_prunes(monkeypatch):
    rng = np.random.default_rng(2)
    points = np.floor(64 * (rng.standard_normal((20, 16))[rng.integers(0, 20, 5000)] * 4 + 0.1 * rng.standard_normal((5000, 16)))).astype(np.int64)
    tree = ct.CoverTree(np.arange(5000), np.zeros(5000, np.int64), points)
    up = ct.augmented(tree.points, tree.size)
    for i in range(len(tree.start)):
        assert (ct.distances(up[tree.start[i]:tree.end[i]], tree.centre[i]) <= tree.radius[i] * (1 + 1e-9) + 1e-9).all()
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        if len(kids):
            assert sorted((tree.start[k], tree.end[k]) for k in kids)[0][0] == tree.start[i]
            assert sum(tree.end[k] - tree.start[k] for k in kids) == tree.end[i] - tree.start[i]
            assert (tree.centre[kids[0]] == tree.centre[i]).all()
    assert sorted(tree.ids) == list(range(5000))
    looked = []
    plain = ct.exact_products
    monkeypatch.setattr(ct, "exact_products", lambda p, q, m: (looked.append(len(p) * len(q)), plain(p, q, m))[1])
    who = np.array([17, 400])
    window, score, ids = ct.descend(tree, points[who], np.array([-1, -1]), np.zeros(2, np.int64), True, np.array([0, 1]),
                                    np.full(2, -(1 << 62)), np.full(2, 1 << 62), 10)
    for w, q in enumerate(who):
        want = sorted(zip((-(points @ points[q])).tolist(), range(5000)))[:10]
        assert list(zip((-score[window == w]).tolist(), ids[window == w].tolist())) == want
    assert sum(looked) < 2 * 1500


def test_bounds_hold():
    rng = np.random.default_rng(4)
    points = rng.integers(-300, 300, (500, 12))
    tree = ct.CoverTree(np.arange(500), np.zeros(500, np.int64), points)
    for q in rng.integers(-300, 300, (40, 12)).astype(float):
        low, high = ct.bounds(q, tree.centre, tree.radius, tree.size)
        for i in range(len(tree.start)):
            s = tree.points[tree.start[i]:tree.end[i]] @ q
            assert low[i] <= s.min() and s.max() <= high[i]
