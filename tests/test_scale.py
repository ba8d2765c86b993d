"""What must not grow with the catalogue or the history: broadcasts, postings, rows expanded, work per slot."""

from pyspark.sql import functions as F

from affinity.functions.joins import BYTES_CONF, PLAN_SIDES, ROWS_CONF, Size, within_plan
from affinity.operators import candidates, recommend, tags
from affinity.operators.distribution import dense_distribution, user_tag_distribution
from affinity.operators.popularity import item_popularity
from affinity.operators.sampling import top_tags
from affinity.sources.inputs import load_inputs, load_item_tags
from conftest import HISTORY_SCHEMA, PROFILE_SCHEMA, TAGS_SCHEMA


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _one_tag_inputs(spark, n_items=60):
    """Items of one bag, item i clicked i + 1 times, and a user who knows only the first."""
    history = [(f"w{j}", f"v{i:02d}", "2017-02-01") for i in range(n_items) for j in range(i + 1)]
    return load_inputs(spark.createDataFrame([("u", "A", "P")], PROFILE_SCHEMA),
                       spark.createDataFrame(history + [("u", "v00", "2017-02-01")], HISTORY_SCHEMA),
                       spark.createDataFrame([(f"v{i:02d}", "a,b") for i in range(n_items)], TAGS_SCHEMA), 2)


def test_a_table_above_the_measured_caps_is_not_broadcast_for_its_small_files(spark):
    items = load_item_tags(spark.range(60_000).select(
        F.xxhash64("id").alias("video_id"), F.concat_ws(",", F.col("id") % 7, 10 + F.col("id") % 5).alias("video_second_class")), 20)
    history = spark.range(1000).select((F.col("id") % 50).alias("up_id"), F.xxhash64("id").alias("video_id"),
                                       F.lit("2017-02-01").cast("date").alias("play_date"))
    spark.conf.set(ROWS_CONF, "1000")
    try:
        dist = user_tag_distribution(history.hint("merge"), items)
        assert dist.select(F.sum("n")).first()[0] == 2000
        static = user_tag_distribution(history, items)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset(ROWS_CONF)
    files = items.long._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 256 << 10 < int(str(files)) < 10 << 20  # Spark's default would broadcast it, whatever its rows
    right = static[static.index("Join"):].split("\n")[0]
    assert "BuildRight" not in right


def test_postings_hold_only_the_places_asked_for(spark):
    i = _one_tag_inputs(spark)
    postings = candidates.item_postings(i.items, item_popularity(i.history))
    popular = candidates.popular_postings(postings, 4)
    assert sorted((r.tag_idx, r.prank, r.video_id) for r in popular.table.collect()) == [
        (t, p, f"v{60 - p:02d}") for t in (0, 1) for p in (1, 2, 3, 4)]
    assert postings.classes.count() == 59 and postings.signatures.count() == 2


def test_only_classes_within_reach_are_expanded(spark):
    """One signature holds all items; a user asks for two of them, not for the whole signature."""
    i = _one_tag_inputs(spark)
    selected = top_tags(user_tag_distribution(i.history.filter("up_id = 'u'"), i.items), "up_id", 2)
    got = candidates.top_candidates(selected, 2, 2, candidates.item_postings(i.items, item_popularity(i.history)))
    assert sorted(r.video_id for r in got.collect()) == ["v58", "v59"]


def test_vectors_are_laid_out_without_a_look_up_per_slot(spark):
    items = load_item_tags(spark.createDataFrame(
        [("v", "c,a"), ("v", "a"), ("w", "b"), ("x", "e,d,c,b,a")], TAGS_SCHEMA), 6)
    assert {r.video_id: r.bag for r in items.bags.collect()} == {
        "v": [2, 0, 1, 0, 0, 0], "w": [0, 1, 0, 0, 0, 0], "x": [1, 1, 1, 1, 1, 0]}
    assert sorted((r.video_id, r.tags) for r in items.dense().collect()) == [
        ("v", [1, 0, 0, 0, 0, 0]), ("v", [1, 0, 1, 0, 0, 0]), ("w", [0, 1, 0, 0, 0, 0]), ("x", [1, 1, 1, 1, 1, 0])]
    dist = spark.createDataFrame([("u", 4, 0.25), ("u", 1, 0.5), ("u", 9, 0.25), ("w", 0, None)],
                                 "up_id string, tag_idx int, prob double")
    dense = dense_distribution(dist, "up_id", 6)
    assert {r.up_id: r.prob for r in dense.collect()} == {"u": [0, 0.5, 0, 0, 0.25, 0], "w": [0.0] * 6}
    for df in (tags.item_bags(items.long, 6).drop("path"), dense):
        assert "map_from_entries(e" not in _plan(df) and "map_from_entries(collect" not in _plan(df)
    # the generator's vector is built once: no test of its size in a filter below
    assert "Filter ((size(" not in _plan(tags.tag_index_list(items.dense())).replace("size(_tokens", "")
    assert sorted(map(tuple, tags.tag_index_list(items.dense()).filter("video_id = 'v'").collect())) == [
        ("v", 0), ("v", 0), ("v", 2)]


def _two_window_history(spark, profile):
    """Users with and without a full recent list over ten items of one tag set; every user has an old event."""
    recent = [("full", f"v{j}", "2017-02-01") for j in range(2)] + [("short", f"v{j}", "2017-02-01") for j in range(9)]
    old = [(u, "v9", "2016-01-01") for u in ("full", "short")]
    return load_inputs(spark.createDataFrame(profile, PROFILE_SCHEMA),
                       spark.createDataFrame(recent + old + [("x", "v9", "2016-01-02")], HISTORY_SCHEMA),
                       spark.createDataFrame([(f"v{j}", "a,b") for j in range(10)], TAGS_SCHEMA), 2)


def test_users_with_a_full_recent_list_leave_the_whole_history_pass(spark, monkeypatch):
    i = _two_window_history(spark, [("full", "A", "P"), ("short", "A", "P")])
    asked, given = [], recommend.user_distribution_of
    monkeypatch.setattr(recommend, "user_distribution_of", lambda pairs, items: asked.append(pairs) or given(pairs, items))
    rows = recommend.recommend_user_two_window(i.history, i.items, 2, 2, "20170202", 28).collect()
    assert {r["source"] for r in rows if r["up_id"] == "full"} == {recommend.RECENT}
    assert sorted(r["up_id"] for r in asked[1].select("up_id").distinct().collect()) == ["short", "x"]


def test_the_label_fill_reads_the_seen_pairs_of_short_users_only(spark, monkeypatch):
    i = _two_window_history(spark, [("full", "A", "P"), ("short", "A", "P")])
    passed, given = [], recommend.recommend_by_label
    monkeypatch.setattr(recommend, "recommend_by_label",
                        lambda label, dist, pop, items, profile, seen, *a, **b:
                        passed.append(seen) or given(label, dist, pop, items, profile, seen, *a, **b))
    recommend.recommend_label_two_window("city", i.profile, i.history, i.items, 2, 2, "20170202", 28).collect()
    assert [r["up_id"] for r in passed[1].pairs.select("up_id").distinct().collect()] == ["short"]
    assert passed[1].counts.collect() == [("short", 10)]


def test_written_pairs_are_not_made_distinct_again(spark):
    pairs = _two_window_history(spark, [("full", "A", "P")]).history.select("up_id", "video_id")
    seen = recommend.written_seen(pairs.distinct())
    assert "Aggregate" in _plan(recommend.seen_by_user(pairs)) and "Aggregate" not in _plan(seen.counts)
    assert sorted(seen.counts.collect()) == [("full", 3), ("short", 10), ("x", 1)]


def test_the_broadcast_sides_of_one_plan_share_the_drivers_memory(spark):
    """Each side is below the cap; all six together are not, and the list stays the same without some of them."""
    i = _one_tag_inputs(spark)
    selected = top_tags(user_tag_distribution(i.history, i.items), "up_id", 2)
    postings = candidates.item_postings(i.items, item_popularity(i.history))
    popular = candidates.popular_postings(postings, 2)
    sizes = [popular.size, *postings.block_sizes, postings.signature_size, postings.class_size, postings.item_size]
    want = sorted(map(tuple, candidates.top_candidates(selected, 2, 2, postings).collect()))
    spark.conf.set(BYTES_CONF, str(max(s.bytes for s in sizes)))
    try:
        cap = int(spark.conf.get(BYTES_CONF))
        assert sum(s.bytes for s in sizes) > PLAN_SIDES * cap
        got = candidates.top_candidates(selected, 2, 2, postings)
        hints = got._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")
        assert 0 < hints < len(sizes)
        assert sorted(map(tuple, got.collect())) == want
        one, half = Size(1, cap), Size(1, cap // 2)
        assert within_plan(selected, [half, one, one, half, None]) == [half, one, None, half, None]
    finally:
        spark.conf.unset(BYTES_CONF)
