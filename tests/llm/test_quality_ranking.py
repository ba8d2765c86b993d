import random
import zlib

import numpy as np

from affinity.llm import quality_ranking as qr
from tests.llm.helpers import docs

WORDS = ["lorem", "ipsum", "dolor", "amet", "magna", "vita", "terra", "sol"]


def corpus(n=600):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = rng.choices(WORDS, k=rng.randint(5, 80))
        text = " ".join(words).capitalize() + "." if good else "!! ".join([rng.choice(WORDS).upper()] * len(words))
        rows.append((i, text))
        marks.append((i, int(good), 0))
    return rows, marks


def test_held_out_accuracy_and_fold(spark):
    rows, marks = corpus()
    labels = spark.createDataFrame(marks + [(None, 1, 0), (3, None, 0), marks[5]], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + [(9000, None), (9001, ""), (None, "Lorem ipsum."), (1, rows[1][1]), (9002, "x " * 200_000)])
    got = qr.score(table, qr.train(table, labels)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _ in marks}
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_held_out_labels_do_not_change_the_model(spark):
    rows, marks = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    table, kind = docs(spark, rows), "doc_id long, quality int, toxic int"
    a, b = (qr.train(table, spark.createDataFrame(m, kind)) for m in (marks, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_pairwise_loss_is_minimised():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, qr.N_FEATURES))
    good = (x[:, 0] + 0.5 * rng.standard_normal(400) > 0).astype(int)
    model = qr.fit(x, good, pairs=5000)
    z = (x - model.mean) / model.deviation
    r = np.random.default_rng(qr.SEED)
    up, down = z[good == 1], z[good == 0]
    d = up[r.integers(0, len(up), 5000)] - down[r.integers(0, len(down), 5000)]

    def loss(w):
        return np.log1p(np.exp(-d @ w)).mean() + qr.RIDGE / 2 * w @ w
    best = loss(model.weights)
    for _ in range(50):
        assert loss(model.weights + 0.05 * rng.standard_normal(len(model.weights))) >= best
    assert model.weights[0] == model.weights.max()


def test_no_labels_one_mark_empty_table(spark):
    kind = "doc_id long, quality int, toxic int"
    table = docs(spark, [(i, f"text {i}") for i in range(10)])
    for marks in ([], [(i, 1, 0) for i in range(10)]):
        got = qr.score(table, qr.train(table, spark.createDataFrame(marks, kind))).collect()
        assert {round(r["score"], 9) for r in got} == {0.3} and {r["predicted"] for r in got} == {1}
    empty = docs(spark, [])
    model = qr.train(empty, spark.createDataFrame([(1, 1, 0)], kind))
    assert qr.score(empty, model).collect() == [] and qr.keep_good(empty, model).collect() == []


def test_keep_good_filters_by_the_score(spark):
    rows, marks = corpus(200)
    table = docs(spark, rows)
    model = qr.train(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    kept = qr.keep_good(table, model)
    assert kept.columns == table.columns
    want = {r["doc_id"] for r in qr.score(table, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_threshold_covers_all_documents_and_labels(spark):
    rows, marks = corpus(400)
    plain = [(10_000 + i, t) for i, t in rows for i in (i, i + 1000) if t.endswith(".")]  # without labels, and better
    table = docs(spark, rows + plain)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = qr.train(table, labels, max_rows=60)
    x = np.array([qr.features(t) for _, t in rows + plain])
    share = np.mean([q == 0 for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5])
    strengths = model.strength(x)
    assert abs(model.threshold - np.quantile(strengths, share)) < 1e-9 and abs(model.scale - strengths.std() / 4) < 1e-9


def test_exact_quantile(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for ranks, n in ((100_000, 1), (100_000, 50), (50, 5000)):
        monkeypatch.setattr(qr, "RANKS", ranks)
        s = np.round(rng.standard_normal(n), 2)
        values = spark.createDataFrame([(float(v),) for v in s], "s double")
        for share in (0.0, 0.137, 1.0):
            assert abs(qr._quantile(values, share) - np.quantile(s, share)) < 1e-12
