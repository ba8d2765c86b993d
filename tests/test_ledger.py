"""Semantics a naive rebuild would get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinity.operators.distribution import (label_tag_distribution, long_from_dense,
                                             user_tag_distribution)
from affinity.operators.drift import kl_divergence
from affinity.operators.evaluate import holdout_split, recommendation_precision, split_summary
from affinity.operators.popularity import item_popularity
from affinity.operators.recommend import (recommend_by_label, recommend_by_user,
                                          recommend_user_two_window)
from affinity.operators.sampling import _position, sample_tags, top_tags
from affinity.sources.inputs import (label_column, load_history, load_inputs, load_item_tags,
                                     undated_events)
from conftest import HISTORY_SCHEMA, PROFILE_SCHEMA, TAGS_SCHEMA


def tags_frame(spark, rows):
    return spark.createDataFrame(rows, TAGS_SCHEMA)


def history_frame(spark, rows):
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def test_dirty_tag_lists(spark):
    items = load_item_tags(tags_frame(spark, [
        ("a1", ",a"), ("a2", "a,"), ("a3", "a,a"), ("a4", "b,,c"), ("a5", None), ("", "x")]), 5)
    assert [(r.tag, r.tag_idx) for r in items.dictionary.orderBy("tag_idx").collect()] == [
        ("a", 0), ("b", 1), ("c", 2)]
    long = sorted((r.video_id, r.tag) for r in items.long.collect())
    assert long == [("a1", "a"), ("a2", "a"), ("a3", "a"), ("a4", "b"), ("a4", "c")]
    dense = {r.video_id: list(r.tags) for r in items.dense().collect()}
    assert dense["a3"] == [1, 0, 0, 0, 0] and dense["a4"] == [0, 1, 1, 0, 0]


def test_lexicographic_dictionary(spark):
    items = load_item_tags(tags_frame(spark, [("v", "2,10,1,0")]), 4)
    order = [r.tag for r in items.dictionary.orderBy("tag_idx").collect()]
    assert order == ["0", "1", "10", "2"]


def test_more_tags_than_vector_length(spark):
    with pytest.raises(ValueError):
        load_item_tags(tags_frame(spark, [("v1", "a,b"), ("v2", "c")]), 2)


def test_repeated_item_rows_count_twice(spark):
    # bag semantics per item: two tag rows for v1 -> its events count for both
    inputs = load_inputs(spark.createDataFrame([("u", "X", "p")], PROFILE_SCHEMA),
                         history_frame(spark, [("u", "v1", "2017-01-01")]),
                         tags_frame(spark, [("v1", "a"), ("v1", "a,b")]), 2)
    dist = user_tag_distribution(inputs.history, inputs.items)
    assert {(r.tag_idx, r.n) for r in dist.collect()} == {(0, 2), (1, 1)}


def _tie_inputs(spark):
    history = history_frame(spark, [("u1", "i0", "2017-01-01"), ("u2", "i1", "2017-01-01"),
                                    ("u3", "i2", "2017-01-01")])
    tags = tags_frame(spark, [("i0", "t"), ("i1", "t"), ("i2", "t")])
    profile = spark.createDataFrame([("u1", "C", "P"), ("u2", "C", "P"), ("u3", None, "P"),
                                     ("u4", "", "P")], PROFILE_SCHEMA)
    return load_inputs(profile, history, tags, 2)


def test_rank_ties_kept_or_broken(spark):
    i = _tie_inputs(spark)
    dist = user_tag_distribution(i.history, i.items)
    pop = item_popularity(i.history)
    keep = recommend_by_user(dist, pop, i.items, i.history, 1, 1)
    u1 = sorted(r.video_id for r in keep.filter("up_id = 'u1'").collect())
    assert u1 == ["i1", "i2"]                       # tie at rank 1 -> both kept
    broken = recommend_by_user(dist, pop, i.items, i.history, 1, 1, ties="break")
    assert [r.video_id for r in broken.filter("up_id = 'u1'").collect()] == ["i1"]


def test_null_and_empty_labels(spark):
    i = _tie_inputs(spark)
    dist = label_tag_distribution("city", i.profile, i.history, i.items)
    labels = {r.reside_city for r in dist.collect()}
    assert labels == {"C", None}                     # NULL is a group in the distribution
    given = spark.createDataFrame([("C", [1.0, 0.0]), ("", [1.0, 0.0]), (None, [1.0, 0.0])],
                                  "reside_city STRING, prob ARRAY<DOUBLE>")
    recs = recommend_by_label("city", long_from_dense(given, "reside_city"),
                              item_popularity(i.history), i.items, i.profile, i.history, 1, 3)
    users = {r.up_id for r in recs.collect()}
    assert users == {"u1", "u2", "u4"}               # u3 (NULL city) gets nothing, "" is a label


def test_phone_label_and_unknown_label(spark):
    i = _tie_inputs(spark)
    dist = label_tag_distribution("phone", i.profile, i.history, i.items)
    assert {r.phone_type for r in dist.collect()} == {"P"}
    recs = recommend_by_label("phone", dist, item_popularity(i.history), i.items, i.profile,
                              i.history, 1, 3)
    assert recs.count() > 0
    with pytest.raises(ValueError):
        label_column("country")


def test_two_window_fill_from_whole_history(spark):
    # u1 recently watched only r0 (tag a); the recent window offers one unseen
    # item (r1).  Whole history adds tag b items.
    history = history_frame(spark, [
        ("u1", "r0", "2017-06-30"), ("u2", "r1", "2017-06-29"),
        ("u1", "o0", "2017-01-01"), ("u3", "o1", "2017-01-02"), ("u3", "o2", "2017-01-03"),
        ("u3", "o2", "2017-01-04")])
    tags = tags_frame(spark, [("r0", "a"), ("r1", "a"), ("o0", "b"), ("o1", "b"), ("o2", "b")])
    i = load_inputs(spark.createDataFrame([("u1", "C", "P")], PROFILE_SCHEMA), history, tags, 2)
    out = recommend_user_two_window(i.history, i.items, 2, 3, "20170630", 7)
    u1 = sorted((r.rank, r.video_id, r.source) for r in out.filter("up_id = 'u1'").collect())
    assert u1[0] == (1, "r1", 0)                      # recent first
    assert [(r, s) for r, _, s in u1[1:]] == [(2, 1), (3, 1)]
    assert {v for _, v, _ in u1[1:]} == {"o1", "o2"}  # never seen, never repeated
    seen = {(r.up_id, r.video_id) for r in i.history.collect()}
    assert not any((u, v) in seen for u, v in
                   [(r.up_id, r.video_id) for r in out.collect()])


def test_split_day_in_both_parts(spark):
    h = load_inputs(spark.createDataFrame([("u", "C", "P")], PROFILE_SCHEMA),
                    history_frame(spark, [("u", "v", "2017-03-01"), ("u", "w", "2017-02-01")]),
                    tags_frame(spark, [("v", "a")]), 1).history
    code = holdout_split(h, "20170301", 7, "code")
    assert code.train.count() == 2 and code.test.count() == 1
    hold = holdout_split(h, "20170301", 7, "holdout")
    assert hold.train.count() == 1 and hold.test.count() == 1
    assert hold.rec_date == dt.date(2017, 2, 22)


def test_precision_null_when_nothing_recommended(spark):
    empty = spark.createDataFrame([], "up_id STRING, video_id STRING")
    test = spark.createDataFrame([("u", "v")], "up_id STRING, video_id STRING")
    r = recommendation_precision(empty, test).collect()[0]
    assert (r.hits, r.recommended, r.precision) == (0, 0, None)
    recs = spark.createDataFrame([("u", "v"), ("u", "w")], "up_id STRING, video_id STRING")
    r = recommendation_precision(recs, test).collect()[0]
    assert (r.hits, r.recommended, r.precision) == (1, 2, 0.5)


def _manual_kl(p, q, d, sigma=1e-4):
    import math

    def smooth(v):
        nz = sum(1 for x in v if x > 0)
        z = d - nz
        full = v + [0.0] * (d - len(v))
        return [sigma if x == 0 else x - z * sigma / nz for x in full]
    ps, qs = smooth(p), smooth(q)
    return sum(a * math.log10(a / b) for a, b in zip(ps, qs))


def test_kl_padding_uses_vector_length(spark):
    schema = "up_id STRING, prob ARRAY<DOUBLE>"
    old = long_from_dense(spark.createDataFrame([("1", [0.5, 0.5])], schema), "up_id")
    new = long_from_dense(spark.createDataFrame([("1", [0.9, 0.1])], schema), "up_id")
    for d in (2, 5):
        kl = kl_divergence(old, new, d).collect()[0].kl
        assert kl == pytest.approx(_manual_kl([0.5, 0.5], [0.9, 0.1], d), rel=1e-12)
    assert kl_divergence(old, new, 5).collect()[0].kl != kl_divergence(old, new, 2).collect()[0].kl


def test_kl_one_sided_users_ignored_and_undefined_flagged(spark):
    schema = "up_id STRING, prob ARRAY<DOUBLE>"
    old = long_from_dense(spark.createDataFrame(
        [("1", [0.5, 0.5, 0.0]), ("2", [1.0, 0.0, 0.0]), ("3", [0.00001, 0.99999, 0.0])],
        schema), "up_id")
    new = long_from_dense(spark.createDataFrame(
        [("1", [0.2, 0.8, 0.0]), ("3", [0.5, 0.5, 0.0])], schema), "up_id")
    kl = {r.up_id: r.kl for r in kl_divergence(old, new, 3).collect()}
    assert set(kl) == {"1", "3"}                      # user 2 is only on one side
    assert kl["3"] is None                            # smoothing drove a value <= 0
    assert kl["1"] == pytest.approx(_manual_kl([0.5, 0.5, 0.0], [0.2, 0.8, 0.0], 3))


def test_direction(spark):
    schema = "up_id STRING, prob ARRAY<DOUBLE>"
    old = long_from_dense(spark.createDataFrame([("1", [0.5, 0.5])], schema), "up_id")
    new = long_from_dense(spark.createDataFrame([("1", [0.9, 0.1])], schema), "up_id")
    back = kl_divergence(old, new, 2, direction="new_old").collect()[0].kl
    assert back == pytest.approx(_manual_kl([0.9, 0.1], [0.5, 0.5], 2))


def test_sampling_is_seeded_and_bounded(spark):
    dist = spark.createDataFrame([(f"k{j}", t, c, 10) for j in range(50)
                                  for t, c in enumerate([1, 2, 3, 4])],
                                 "key STRING, tag_idx INT, n BIGINT, total BIGINT")
    dist = dist.withColumn("prob", F.col("n") / F.col("total"))
    a = {(r.key, r.tag_idx) for r in sample_tags(dist, "key", 3, 7).collect()}
    b = {(r.key, r.tag_idx) for r in sample_tags(dist, "key", 3, 7).collect()}
    c = {(r.key, r.tag_idx) for r in sample_tags(dist, "key", 3, 8).collect()}
    assert a == b and a != c
    per_key = {}
    for k, _ in a:
        per_key[k] = per_key.get(k, 0) + 1
    assert max(per_key.values()) <= 3 and min(per_key.values()) >= 1
    top = top_tags(dist, "key", 2).filter("key = 'k0'").collect()
    assert sorted(r.tag_idx for r in top) == [2, 3]


def test_sampling_inclusion_rate(spark):
    keys, k, counts = 4000, 3, [1, 2, 3, 4]
    pairs = F.array(*[F.struct(F.lit(t).alias("tag_idx"), F.lit(c).cast("bigint").alias("n"))
                      for t, c in enumerate(counts)])
    dist = (spark.range(keys).select(F.col("id").alias("key"), F.explode(pairs).alias("e"))
            .select("key", "e.tag_idx", "e.n"))
    dist = dist.withColumn("total", F.lit(sum(counts)).cast("bigint")).withColumn(
        "prob", F.col("n") / F.col("total"))
    hits = {r.tag_idx: r["count"] for r in
            sample_tags(dist, "key", k, 42).groupBy("tag_idx").count().collect()}
    for t, c in enumerate(counts):
        p = c / sum(counts)
        assert hits.get(t, 0) / keys == pytest.approx(1 - (1 - p) ** k, abs=0.03)


def test_zero_probability_never_drawn(spark):
    given = spark.createDataFrame([(str(j), [0.5, 0.0, 0.5]) for j in range(200)],
                                  "up_id STRING, prob ARRAY<DOUBLE>")
    drawn = {r.tag_idx for r in sample_tags(long_from_dense(given, "up_id"), "up_id", 5).collect()}
    assert drawn == {0, 2}


def test_dedupe_option(spark):
    tags = tags_frame(spark, [("v1", "a"), ("v1", "a")])
    profile = spark.createDataFrame([("u", "X", "p"), ("u", "X", "p")], PROFILE_SCHEMA)
    history = history_frame(spark, [("u", "v1", "2017-01-01")])
    bag = load_inputs(profile, history, tags, 2)
    assert {r.n for r in label_tag_distribution(
        "city", bag.profile, bag.history, bag.items).collect()} == {4}
    deduped = load_inputs(profile, history, tags, 2, dedupe=True)
    assert {r.n for r in label_tag_distribution(
        "city", deduped.profile, deduped.history, deduped.items).collect()} == {1}


def test_empty_tag_table_gives_empty_results(spark):
    i = load_inputs(spark.createDataFrame([("u", "X", "p")], PROFILE_SCHEMA),
                    history_frame(spark, [("u", "v1", "2017-01-01")]),
                    tags_frame(spark, [("v1", ""), ("v2", None)]), 3)
    dist = user_tag_distribution(i.history, i.items)
    pop = item_popularity(i.history)
    assert dist.count() == 0
    assert recommend_by_user(dist, pop, i.items, i.history, 2, 2).count() == 0
    city = label_tag_distribution("city", i.profile, i.history, i.items)
    assert recommend_by_label("city", city, pop, i.items, i.profile, i.history, 2, 2).count() == 0
    assert recommend_user_two_window(i.history, i.items, 2, 2, "20170101", 7).count() == 0


def test_unreadable_dates_are_counted_and_seen(spark):
    h = history_frame(spark, [("u", "a", "2017-01-03"), ("u", "b", "2017/01/03"), ("u", "c", "2017-1-5"),
                              ("u", "d", ""), ("u", "e", None), ("", "f", "2017-01-03")])
    history = load_history(h)
    assert {(r.video_id, r.play_date) for r in history.collect()} == {
        ("a", dt.date(2017, 1, 3)), ("b", None), ("c", None)}
    assert tuple(undated_events(history).first()) == (3, 2)
    assert item_popularity(history, "20170101", "20170201").count() == 1
    tags = tags_frame(spark, [(v, "t") for v in "abcx"])
    i = load_inputs(spark.createDataFrame([("u", "C", "P")], PROFILE_SCHEMA),
                    h.union(history_frame(spark, [("w", v, "2017-01-04") for v in "abcx"])), tags, 1)
    out = recommend_user_two_window(i.history, i.items, 1, 3, "20170131", 31)
    assert [r.video_id for r in out.filter("up_id = 'u'").collect()] == ["x"]


def test_string_dates_are_pruned_at_the_scan(spark, tmp_path):
    rows = [("u", f"v{y}{m}{k}", d) for y in (2015, 2016, 2017) for m in (1, 12)
            for k, d in enumerate((f"{y}-{m:02d}-03", f"{y}{m:02d}03", f"-{y}-{m:02d}-03"))]
    history_frame(spark, rows).write.parquet(str(tmp_path / "h"))
    got = load_history(str(tmp_path / "h"), spark, "20160101", "20161231")
    assert sorted(r.video_id for r in got.collect()) == sorted(v for _, v, d in rows if "2016" in d)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = load_history(str(tmp_path / "h"), spark, "20160101", "20161231")._jdf.queryExecution().executedPlan()
    scan = next(x for x in plan.toString().split("\n") if "PushedFilters" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(play_date,2016)" in scan and "LessThan(play_date,2017)" in scan


def test_draw_positions_are_exact_beyond_bigint_products(spark):
    totals = [1, 7, 2 ** 31 - 1, 2 ** 32, 2 ** 32 + 12345, 2 ** 62 + 987654321, 2 ** 63 - 1]
    hashes = [0, 1, 65535, 65536, 2 ** 31, 2 ** 32 - 1]
    df = spark.createDataFrame([(h, t) for h in hashes for t in totals], "h BIGINT, t BIGINT")
    for r in df.withColumn("p", _position(F.col("h"), F.col("t"))).collect():
        assert r.p == r.h * r.t // 2 ** 32


def test_multi_hot_keeps_repeated_rows_and_drops_empty_lists(spark):
    items = load_item_tags(tags_frame(spark, [("v", "a,b"), ("v", "a,b"), ("w", ","), ("x", "b")]), 3)
    assert sorted((r.video_id, tuple(r.tags)) for r in items.dense().collect()) == [
        ("v", (1, 1, 0)), ("v", (1, 1, 0)), ("x", (0, 1, 0))]


def test_split_summary_equals_the_split(spark):
    i = _tie_inputs(spark)
    got = {(r.split, r.part): r.n_events for r in split_summary(i.history, "20170101", 7).collect()}
    for split in ("code", "holdout"):
        parts = holdout_split(i.history, "20170101", 7, split)
        for name, df in (("train", parts.train), ("test", parts.test)):
            assert got.get((split, name), 0) == df.count()


def test_release_deletes_only_own_tables(spark):
    from affinity.session import cut_lineage, release, written
    mine = spark.range(5).cache()
    assert mine.count() == 5
    older, mark = cut_lineage(spark.range(2), "unit-kept"), written(spark)
    out = cut_lineage(spark.range(3), "unit-release")
    files = out.inputFiles()
    release(spark, since=mark)
    assert older.count() == 2
    import os
    assert not any(os.path.exists(f.replace("file://", "").replace("file:", "")) for f in files)
    assert mine.storageLevel.useMemory
    mine.unpersist()
