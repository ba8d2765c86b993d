import numpy as np
import pytest

from affinity.llm import topk_threshold as tk

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "v") for i, v in rows], SCHEMA)


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all():
            f = np.floor(64 * np.array(v, float)).astype(int).tolist()
            ok[i] = min(ok.get(i, f), f)
    out = []
    for q in sorted(i for i in ok if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


def run(spark, rows, k=20):
    vectors = tk.integer_vectors(table(spark, rows))
    return sorted(map(tuple, tk.top_k(vectors, vectors.where("id % 20 = 0"), k).collect()))


def vectors(n, width=12, seed=0):
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((n, width))
    out[n // 2:n // 2 + n // 5] = out[0]  # ties
    return [(int(i), v.tolist()) for i, v in enumerate(out)]


@pytest.mark.parametrize("shard_rows,group_rows,width", [(16_384, 2_048, 12), (20, 5, 7)])
def test_equals_brute_force(spark, monkeypatch, shard_rows, group_rows, width):
    monkeypatch.setattr(tk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(tk, "GROUP_ROWS", group_rows)
    rows = vectors(260, width)
    rows += [(5000, None), (5001, [None] * width), (5020, [float("nan")] * width), (5040, [float("-inf")] * width),
             (5060, [1.0]), (5080, []), (None, rows[0][1]), rows[7], (5100, [-3.0] * width), (-20, [0.5] * width)]
    assert run(spark, rows) == brute(rows, 20)


def test_fewer_than_k_and_empty(spark):
    rows = vectors(9)
    assert run(spark, rows) == brute(rows, 20) and len(brute(rows, 20)) == 8
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0, 2.0])]) == []


def test_large_components_stay_exact():
    a = np.array([[2 ** 30 + 1, 3], [5, -2 ** 30 - 7]], np.int64)
    assert tk.products(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in a] for r in a]


def test_scores_beyond_64_bits_raise(spark):
    for rows in ([(0, [1e300, 1.0]), (20, [1e300, 2.0])], [(0, [5e7] * 20), (20, [5e7] * 20)]):
        with pytest.raises(ValueError, match="64 bits"):
            run(spark, rows)
    assert run(spark, [(0, [2.0 ** 24]), (20, [2.0 ** 24])]) == brute([(0, [2.0 ** 24]), (20, [2.0 ** 24])], 20)
