"""The parts of the candidate generator: ranks, blocks, label ranks, depths, measured writes."""

import random

import pytest
from pyspark.sql import functions as F

from affinity.functions.joins import measure, write_measured
from affinity.operators import candidates, tags
from affinity.operators.distribution import user_tag_distribution
from affinity.operators.popularity import item_popularity
from affinity.operators.recommend import (best_items, exclude_seen, item_side, label_depth, rank_top_n, score_items)
from affinity.operators.sampling import select_tags
from affinity.sources.inputs import load_inputs
from conftest import HISTORY_SCHEMA, PROFILE_SCHEMA, TAGS_SCHEMA


def _inputs(spark, n_items=60, n_tags=12, seed=1):
    rnd = random.Random(seed)
    rows = [(f"v{v}", ",".join(rnd.sample([f"t{i:02d}" for i in range(n_tags)], rnd.randint(1, 6)))) for v in range(n_items)]
    rows += rows[:10]  # listed twice: multiplicity 2
    history = [(f"u{rnd.randrange(15)}", f"v{min(rnd.randrange(n_items), rnd.randrange(n_items))}", "2017-02-01") for _ in range(300)]
    return load_inputs(spark.createDataFrame([(f"u{u}", "A", "P") for u in range(15)], PROFILE_SCHEMA),
                       spark.createDataFrame(history, HISTORY_SCHEMA), spark.createDataFrame(rows, TAGS_SCHEMA), n_tags)


@pytest.mark.parametrize("rows", [65_536, 8])
def test_one_tag_on_every_item_is_ranked_in_even_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(candidates, "TIE_ROWS", rows)
    rnd = random.Random(2)
    posting = [(0, rnd.choice([1.0, 1.0, 1.0, 0.5, 0.25]), f"v{i}") for i in range(400)] + [(1, 0.5, f"v{i}") for i in range(7)]
    ranked = candidates.popularity_ranks(spark.createDataFrame(posting, "tag_idx int, pop double, video_id string"))
    got = {}
    for r in ranked.collect():
        got.setdefault(r.tag_idx, []).append((r.prank, -r.pop))
    assert sum(map(len, got.values())) == len(posting)
    for tag, places in got.items():
        if rows > 400 or tag == 1:
            assert sorted(p for p, _ in places) == list(range(1, len(places) + 1))
            assert [x for _, x in sorted(places)] == sorted(x for _, x in places)
        for depth in (d for d in (1, 5, 50, len(places)) if d <= len(places)):  # a prefix holds about that many
            assert abs(sum(p <= depth for p, _ in places) - depth) <= max(1, depth // 3)
    # no window holds more than a part: the places within one are few
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
    if rows == 8:
        group = sum(p == 1.0 for t, p, _ in posting if t == 0)
        parts = -(-group // rows)
        spread = spark.createDataFrame(posting, "tag_idx int, pop double, video_id string").where("pop = 1").groupBy(
            F.pmod(F.xxhash64("video_id"), F.lit(parts))).count().collect()
        assert max(r["count"] for r in spread) <= 4 * rows


def test_blocks_bound_their_signatures(spark):
    i = _inputs(spark)
    postings = candidates.item_postings(i.items, item_popularity(i.history))
    steps = candidates._steps(candidates.LEVELS[-1])
    sigs = postings.signatures.collect()
    assert len({(r.tag_idx, r.sig) for r in sigs}) == len(sigs)
    for level, blocks in zip(candidates.LEVELS, postings.blocks):
        known = {tuple(r[c] for c in ("tag_idx", *steps[:level])): r for r in blocks.collect()}
        for r in sigs:
            block = known[tuple(r[c] for c in ("tag_idx", *steps[:level]))]
            held = [t for t, m in enumerate(r.bag) if m]
            assert all(block._union[t >> 6] >> (t & 63) & 1 for t in held) and max(r.bag) <= block._most
        assert len(known) == len({tuple(r[c] for c in ("tag_idx", *steps[:level])) for r in sigs})


def test_paths_begin_with_the_most_common_tags(spark):
    i = _inputs(spark)
    bags = i.items.bags.collect()
    common = {}
    for r in bags:
        for t in r.tags:
            common[t] = common.get(t, 0) + 1
    for r in bags:
        assert r.path == sorted(r.tags, key=lambda t: (-common[t], t))[:tags.PATH]


@pytest.mark.parametrize("unseen", [False, True])
def test_best_items_equal_scoring_everything(spark, unseen):
    i = _inputs(spark, seed=4)
    pop = item_popularity(i.history)
    selected = select_tags(user_tag_distribution(i.history, i.items), "up_id", 4, 4, "sample")
    everything = score_items(selected, "up_id", item_side(i.items, pop))
    if unseen:
        everything = exclude_seen(everything, i.history)
    want = rank_top_n(everything, 6)
    got = best_items(selected, pop, i.items, 4, 6, i.history if unseen else None)
    names = ("up_id", "video_id", "prob_sum", "pop", "rank")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))


def test_ranks_by_counts_equal_rank(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("AB"), f"v{i}", rnd.choice([0.1, 0.2, 0.3]), rnd.choice([0.0, 0.5, 0.7]), lim)
            for i in range(200) for lim in [{"A": 17, "B": 1000}]]
    cand = spark.createDataFrame([(k, v, s, p, lim[k]) for k, v, s, p, lim in rows],
                                 "key string, video_id string, prob_sum double, pop double, lim long")
    got = sorted((r.key, r.video_id, r["rank"]) for r in candidates.ranked_by_counts(cand, "key", "lim", "rank").collect())
    want = []
    for k, v, s, p, lim in rows:
        rank = 1 + sum(k2 == k and (s2, p2) > (s, p) for k2, _, s2, p2, _ in rows)
        if rank <= lim[k]:
            want.append((k, v, rank))
    assert got == sorted(want)
    assert candidates.ranked_by_counts(cand.limit(0), "key", "lim", "rank").collect() == []


def test_depth_counts_only_seen_items_above_the_cut(spark):
    """A user that saw everything unpopular reads no deeper; the depth is the smallest that suffices."""
    rnd = random.Random(8)
    ranks, rank = [], 1
    for i in range(60):  # competition ranks with ties
        if rnd.random() < 0.6:
            rank = i + 1
        ranks.append(("A", f"v{i}", rank))
    lists = write_measured(spark.createDataFrame(ranks, "reside_city string, video_id string, label_rank int"), "unit-lists")
    saw = {"deep": [f"v{i}" for i in range(20, 60)], "top": [f"v{i}" for i in range(12)], "none": [],
           "all": [f"v{i}" for i in range(60)], "some": [f"v{i}" for i in range(60) if rnd.random() < 0.5], "other": ["x1", "x2"]}
    seen = spark.createDataFrame([(u, v) for u, vs in saw.items() for v in vs], "up_id string, video_id string")
    people = spark.createDataFrame([(u, "A") for u in saw] + [("deep", "A")], "up_id string, reside_city string")
    n = 3
    got = {r.up_id: r.depth for r in label_depth("reside_city", lists, people, seen, F.lit(n)).collect()}
    for u, vs in saw.items():
        depth = got.get(u, n)
        at = sorted(r for _, v, r in ranks if v in vs)
        assert depth == next(r for r in range(n, 200) if r - sum(s <= r for s in at) >= n)
        unseen = [(r, v) for _, v, r in ranks if v not in vs]
        for r, v in unseen:  # nothing of the user's top n lies deeper
            if sum(r2 < r for r2, _ in unseen) < n:
                assert r <= depth
    assert got["deep"] == n


def test_written_frames_are_measured_by_their_own_job(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], ["x", None], {"k": [1.5]}), (2, None, None, [], None)],
                               "i long, s string, a array<int>, t array<string>, m map<string,array<double>>")
    got = write_measured(df, "unit-measured", most=F.max("i"), copies=F.col("i").cast("int"))
    assert got.size == measure(got.table, copies=F.col("i").cast("int")) and got.size.rows == 3 and got.seen == {"most": 2}
    wide = spark.createDataFrame([(["x" * 1000] * 10,)], "t array<string>")
    assert measure(wide).bytes > 10_000
    empty = write_measured(df.limit(0), "unit-empty", most=F.max("i"))
    assert empty.size == (0, 0) and empty.seen == {"most": None} and empty.table.collect() == []
    none = write_measured(df.where("false"), "unit-none")
    assert none.size == (0, 0)
