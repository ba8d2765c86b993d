import numpy as np
import pytest

from affinity.llm import mixing
from affinity.llm.common import cut

DOC = "doc_id long, text string, lang string, source string, n_chars long, _s string, mix_weight double, row string, tokens long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, "s", 2.0, "r", 3) for i, t, la, s in rows], DOC)


def corpus(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.integers(1, 1200))), str(rng.choice(["en", "fr", "de"], p=[.7, .2, .1])),
             f"src{min(int(rng.exponential(2)), 9)}") for i in range(n)]


def brute_ipf(cells, want):
    """cells: {(s, l, t): tokens}; alternate scaling until all marginals fit."""
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(3000):
        for axis, goal in enumerate(want):
            for label, share in goal.items():
                keys = [k for k in w if k[axis] == label]
                got = sum(w[k] for k in keys)
                for k in keys:
                    w[k] *= share / got
    return {k: w[k] / cells[k] for k in w}


@pytest.mark.parametrize("given", [False, True])
def test_weights_meet_all_marginals(spark, given):
    cells = cut(mixing.cells_of(table(spark, corpus())), "test-cells")
    targets = {"lang": {"en": 0.5, "fr": 0.25, "de": 0.25}, "source": {f"src{k}": 0.1 for k in range(10)}} if given else None
    got = mixing.rake(cells, targets).collect()
    tokens = {(r["_s"], r["_l"], r["_t"]): r["tokens"] for r in got}
    weight = {(r["_s"], r["_l"], r["_t"]): r["weight"] for r in got}
    want = []
    for axis, name in enumerate(("source", "lang", "topic")):
        totals = {}
        for k, n in tokens.items():
            totals[k[axis]] = totals.get(k[axis], 0) + n
        goal = (targets or {}).get(name) or {k: v ** mixing.TEMPERATURE for k, v in totals.items()}
        goal = {k: goal[k] / sum(goal[j] for j in totals) for k in totals}
        want.append(goal)
        for label, share in goal.items():
            assert abs(sum(tokens[k] * weight[k] for k in tokens if k[axis] == label) - share) < 1e-4
    brute = brute_ipf(tokens, want)
    assert all(abs(weight[k] / brute[k] - 1) < 1e-3 for k in tokens)


def test_sample_follows_the_probabilities(spark):
    rows = corpus(6000)
    docs = table(spark, rows)
    prob = mixing.with_probability(docs).select("row.doc_id", "mix_probability").collect()
    assert len(prob) == len(rows) and all(0 < r["mix_probability"] <= 1 for r in prob)
    kept = mixing.sample(docs).select("row.*")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    expected = sum(r["mix_probability"] for r in prob)
    assert abs(len(ids) - expected) < 5 * expected ** 0.5
    assert ids == {r["doc_id"] for r in mixing.sample(docs).select("row.doc_id").collect()}


def test_nulls_repeats_empty_and_missing_columns(spark):
    rows = corpus(50) + [(100, None, None, None), (None, "x", "en", "src0"), (3, "again", "en", "src0"), (101, "", "", ""),
                         (102, "w " * 200_000, "en", "src0")]
    got = mixing.with_probability(table(spark, rows))
    assert got.count() == len(rows) and got.where("mix_probability IS NULL OR mix_probability <= 0").count() == 0
    assert mixing.sample(table(spark, [])).collect() == []
    bare = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert mixing.sample(bare).select("row.*").count() == 2  # one cell: its weight is the largest
    topical = bare.withColumn("topic", bare["text"])
    assert mixing.with_probability(topical).count() == 2


def test_zero_targets_and_pair_limit(spark, monkeypatch):
    docs = table(spark, corpus(200))
    got = mixing.with_probability(docs, {"lang": {"en": 1.0}}).select("row.lang", "mix_probability").collect()
    assert all((r["mix_probability"] > 0) == (r["lang"] == "en") for r in got)
    monkeypatch.setattr(mixing, "LABEL_PAIRS", 2)
    with pytest.raises(ValueError):
        mixing.with_probability(docs)


CELL = "_s string, _l string, _t string, tokens long"


def off_by(rows, axis, want):
    return max(abs(sum(r["tokens"] * r["weight"] for r in rows if r[axis] == k) - v) for k, v in want.items())


@pytest.mark.parametrize("by_job", [False, True])
def test_a_slow_fit_is_not_given_up(spark, monkeypatch, by_job):
    n = 10 if by_job else 10 ** 6
    cells = cut(spark.createDataFrame([("a", "en", "x", n), ("a", "fr", "x", 1), ("b", "en", "x", 1), ("b", "fr", "x", n)], CELL), "slow")
    if by_job:
        monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    source, lang = {"a": 0.3, "b": 0.7}, {"en": 0.3, "fr": 0.7}
    if not by_job:
        lang = {"en": 0.5, "fr": 0.5}
    rows = mixing.rake(cells, {"source": source, "lang": lang}).collect()
    assert off_by(rows, "_s", source) <= 2e-6 and off_by(rows, "_l", lang) <= 2e-6


@pytest.mark.parametrize("by_job", [False, True])
def test_marginals_that_cannot_be_met_are_told(spark, monkeypatch, by_job):
    cells = cut(spark.createDataFrame([("a", "en", "x", 90), ("b", "fr", "x", 10), ("b", "en", "x", 5)], CELL), "short")
    if by_job:
        monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-2)  # few sweeps: each is a job
    with pytest.warns(RuntimeWarning, match="no weights meet.*lang is off by 0.2"):
        rows = mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "fr": 0.5}}).collect()
    assert off_by(rows, "_s", {"a": 0.7, "b": 0.3}) < 1e-9


@pytest.mark.parametrize("name", ["source", "lang", "topic"])
def test_a_target_without_any_category_of_the_data_is_named(spark, name):
    rows = [(i, "some words here", "en", f"s{i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match=f"no {name} that the target names"):
        mixing.sample(docs, targets={name: {"zz": 1.0}})
