"""The reference suite's golden values, on its own fixture rows."""

import pytest

from affinity.functions.kl import kl_dense
from affinity.operators.distribution import (dense_distribution, label_tag_distribution,
                                             long_from_dense, user_tag_distribution)
from affinity.operators.drift import kl_divergence, kl_summary
from affinity.operators.popularity import item_popularity
from affinity.operators.recommend import recommend_by_label, recommend_by_user
from conftest import FROM_DATE, K, N, N_TAGS, TO_DATE


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_loaders(fixture_inputs):
    items = fixture_inputs.items
    assert rows(items.dictionary, "tag", "tag_idx") == {("0", 0), ("1", 1), ("2", 2)}
    # the item with an empty tag list is dropped on load
    assert {r.video_id for r in items.rows.collect()} == {"1", "2", "3"}
    dense = {r.video_id: list(r.tags) for r in items.dense().collect()}
    assert dense == {"1": [1, 0, 0], "2": [0, 1, 0], "3": [1, 1, 1]}
    assert fixture_inputs.history.count() == 8
    assert fixture_inputs.profile.count() == 4


def test_city_distribution(fixture_inputs):
    i = fixture_inputs
    dist = label_tag_distribution("city", i.profile, i.history, i.items, FROM_DATE, TO_DATE)
    dense = dense_distribution(dist, "reside_city", N_TAGS).collect()
    assert [(r.reside_city, list(r.prob)) for r in dense] == [("Beijing", [0.4, 0.4, 0.2])]


def test_user_distribution(fixture_inputs):
    i = fixture_inputs
    dist = user_tag_distribution(i.history, i.items, FROM_DATE, TO_DATE)
    dense = {r.up_id: list(r.prob) for r in dense_distribution(dist, "up_id", N_TAGS).collect()}
    assert dense == {"1": [0.5, 0.5, 0.0], "2": [0.25, 0.5, 0.25], "3": [0.5, 0.25, 0.25]}


def test_popularity(fixture_inputs):
    pop = item_popularity(fixture_inputs.history, FROM_DATE, TO_DATE)
    assert rows(pop, "video_id", "pop") == {("1", 1 / 3), ("2", 1 / 3), ("3", 1 / 3)}


def test_recommend_city(spark, fixture_inputs):
    i = fixture_inputs
    given = spark.createDataFrame([("Beijing", [0.0, 0.0, 1.0])],
                                  "reside_city STRING, prob ARRAY<DOUBLE>")
    recs = recommend_by_label("city", long_from_dense(given, "reside_city"),
                              item_popularity(i.history, FROM_DATE, TO_DATE), i.items,
                              i.profile, i.history, K, N)
    assert rows(recs, "up_id", "video_id", "prob_sum", "pop") == {("1", "3", 1.0, 1 / 3)}


def test_recommend_user(spark, fixture_inputs):
    i = fixture_inputs
    given = spark.createDataFrame([("1", [0.0, 0.0, 1.0]), ("2", [0.0, 0.0, 1.0]),
                                   ("3", [0.0, 1.0, 0.0])], "up_id STRING, prob ARRAY<DOUBLE>")
    recs = recommend_by_user(long_from_dense(given, "up_id"),
                             item_popularity(i.history, FROM_DATE, TO_DATE), i.items,
                             i.history, K, N)
    assert rows(recs, "up_id", "video_id", "prob_sum", "pop") == {
        ("1", "3", 1.0, 1 / 3), ("3", "2", 1.0, 1 / 3)}


def test_kl_summary(spark):
    schema = "up_id STRING, prob ARRAY<DOUBLE>"
    old = spark.createDataFrame([("1", [0.1, 0.1]), ("2", [0.2, 0.2])], schema)
    new = spark.createDataFrame([("1", [0.1, 0.01]), ("2", [0.2, 0.02])], schema)
    kl = kl_divergence(long_from_dense(old, "up_id"), long_from_dense(new, "up_id"), 2)
    s = kl_summary(kl).collect()[0]
    assert s.kl_min == pytest.approx(0.1) and s.kl_max == pytest.approx(0.2)
    assert abs(s.kl_avg - 0.15) < 0.01 and abs(s.kl_var - 0.0025) < 0.0001
    assert s.n_users == 2 and s.n_undefined == 0
    # the dense column form agrees
    dense = old.join(new.withColumnRenamed("prob", "q"), "up_id").select(
        "up_id", kl_dense("prob", "q").alias("kl"))
    assert {r.up_id: round(r.kl, 12) for r in dense.collect()} == {"1": 0.1, "2": 0.2}


def test_sql_views(spark, fixture_inputs):
    from affinity.plans.views import register_views
    register_views(fixture_inputs, FROM_DATE, TO_DATE, prefix="fx_")
    rows = spark.sql("""
        SELECT d.reside_city, t.tag, d.prob
        FROM fx_city_tag_dist d JOIN fx_tag_dictionary t ON d.tag_idx = t.tag_idx
        ORDER BY t.tag""").collect()
    assert [(r.reside_city, r.tag, r.prob) for r in rows] == [
        ("Beijing", "0", 0.4), ("Beijing", "1", 0.4), ("Beijing", "2", 0.2)]
