"""The score-floor generator against brute force on random small fixtures.

The fixtures have what the generated tables lack: items listed in several tag
rows (a tag counted twice), repeated tokens, users who have seen most items,
long tag lists, tails of one-click items, and many ties in score and popularity.
"""

import random

import pytest

from affinity.functions.joins import ROWS_CONF
from affinity.operators.distribution import (label_tag_distribution, long_from_dense,
                                             user_tag_distribution)
from affinity.operators.popularity import item_popularity
from affinity.operators.recommend import recommend_by_label, recommend_by_user
from affinity.operators.sampling import select_tags
from affinity.sources.inputs import load_inputs
from conftest import HISTORY_SCHEMA, PROFILE_SCHEMA, TAGS_SCHEMA


def _fixture(spark, seed, n_items=30, n_tags=7, most=3, tail=0):
    rnd = random.Random(seed)
    n_users, vocab = 25, [f"t{i:02d}" for i in range(n_tags)]
    tag_rows = []
    for v in range(n_items + tail):
        for _ in range(rnd.choice([1, 1, 2])):          # some items in two rows
            toks = rnd.sample(vocab, rnd.randint(1, most))
            if rnd.random() < 0.2:
                toks.append(toks[0])                    # repeated token in a row
            tag_rows.append((f"v{v}", ",".join(toks)))
    history = []
    for u in range(n_users):
        heavy = u % 6 == 0
        for _ in range(rnd.randint(60, 90) if heavy else rnd.randint(1, 6)):
            day = rnd.randint(1, 28)
            history.append((f"u{u}", f"v{rnd.randrange(n_items)}", f"2017-02-{day:02d}"))
    history += [(f"w{v}", f"v{n_items + v}", "2017-02-01") for v in range(tail)]
    profile = [(f"u{u}", "A" if u % 10 else rnd.choice(["B", ""]), rnd.choice(["P", "Q"]))
               for u in range(n_users)]
    return load_inputs(spark.createDataFrame(profile, PROFILE_SCHEMA),
                       spark.createDataFrame(history, HISTORY_SCHEMA),
                       spark.createDataFrame(tag_rows, TAGS_SCHEMA), n_tags)


CASES = {"short lists": {}, "long lists": {"n_tags": 60, "most": 50}, "one-click tail": {"tail": 60}}


def _bags(items):
    out = {}
    for r in items.long.collect():
        bag = out.setdefault(r.video_id, {})
        bag[r.tag_idx] = bag.get(r.tag_idx, 0) + 1
    return out


def _brute_scores(selected, key, items, pop):
    """{key: [(video, prob_sum, pop)]} over all items of the window, summed in the key's tag order."""
    tags, bags, pops = {}, _bags(items), {r.video_id: r.pop for r in pop.collect()}
    integral = not any(isinstance(r.n, float) for r in selected.collect())
    for r in selected.collect():
        tags.setdefault(r[key], []).append((-r.n, r.tag_idx, r.total))
    out = {}
    for k, chosen in tags.items():
        for v, p in pops.items():
            bag = bags.get(v, {})
            if any(t in bag for _, t, _ in chosen):
                score = 0
                for n, t, _ in sorted(chosen):
                    score += -n * bag.get(t, 0)
                out.setdefault(k, []).append((v, score / chosen[0][2] if integral else score, p))
    return out


def _ranked(candidates, seen, n):
    rows = sorted(((-s, -p, v) for v, s, p in candidates if v not in seen))
    out = []
    for k, (s, p, v) in enumerate(rows):
        rank = out[-1][0] if k and rows[k - 1][:2] == (s, p) else k + 1
        out.append((rank, v, -s, -p))
    return [(v, s, p, r) for r, v, s, p in out if r <= n]


def _seen(history):
    out = {}
    for r in history.collect():
        out.setdefault(r.up_id, set()).add(r.video_id)
    return out


def _rows(df):
    return sorted((r.up_id, r.video_id, r.prob_sum, r.pop, r.rank) for r in df.collect())


def _user_lists(selected, i, pop, n):
    seen = _seen(i.history)
    return sorted((u, *row) for u, cand in _brute_scores(selected, "up_id", i.items, pop).items()
                  for row in _ranked(cand, seen.get(u, set()), n))


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("mode", ["sample", "top"])
def test_user_lists_equal_brute_force(spark, case, mode):
    i = _fixture(spark, 2, **CASES[case])
    dist, pop, k, n = user_tag_distribution(i.history, i.items), item_popularity(i.history), 4, 3
    got = _rows(recommend_by_user(dist, pop, i.items, i.history, k, n, 2, mode))
    assert got == _user_lists(select_tags(dist, "up_id", k, 2, mode), i, pop, n)


def test_user_lists_without_broadcasts(spark):
    i = _fixture(spark, 3)
    dist, pop = user_tag_distribution(i.history, i.items), item_popularity(i.history)
    want = _user_lists(select_tags(dist, "up_id", 4, 3), i, pop, 3)
    spark.conf.set(ROWS_CONF, "0")
    try:
        assert _rows(recommend_by_user(dist, pop, i.items, i.history, 4, 3, 3)) == want
    finally:
        spark.conf.unset(ROWS_CONF)


def test_double_vectors_with_near_ties(spark):
    """Sums that tie or differ in the last bit rank the same in every pass."""
    i = _fixture(spark, 5, n_items=40, n_tags=6, most=4)
    rnd = random.Random(5)
    given = [(f"u{u}", [rnd.choice([0.1, 0.2, 0.3, 0.6, 0.1 + 0.2, 0.0]) for _ in range(6)]) for u in range(25)]
    dist = long_from_dense(spark.createDataFrame(given, "up_id STRING, prob ARRAY<DOUBLE>"), "up_id")
    pop = item_popularity(i.history)
    got = _rows(recommend_by_user(dist, pop, i.items, i.history, 6, 2, mode="top"))
    assert got == _user_lists(select_tags(dist, "up_id", 6, mode="top"), i, pop, 2)


def test_equal_double_sums_tie(spark):
    """0.3 + 0.2 + 0.1 and 0.6 tie at equal popularity: both items are kept."""
    i = load_inputs(spark.createDataFrame([("u", "A", "P")], PROFILE_SCHEMA),
                    spark.createDataFrame([("w", "X", "2017-02-01"), ("w", "Y", "2017-02-01")], HISTORY_SCHEMA),
                    spark.createDataFrame([("X", "t2,t1,t0"), ("Y", "t3")], TAGS_SCHEMA), 4)
    dist = long_from_dense(spark.createDataFrame([("u", [0.1, 0.2, 0.3, 0.6])], "up_id STRING, prob ARRAY<DOUBLE>"),
                           "up_id")
    got = recommend_by_user(dist, item_popularity(i.history), i.items, i.history, 4, 1, mode="top")
    assert {r.video_id for r in got.collect()} == {"X", "Y"}


@pytest.mark.parametrize("case", CASES)
def test_label_lists_equal_brute_force(spark, case):
    """One label holds 90 % of the users; some have seen most items."""
    i = _fixture(spark, 4, **CASES[case])
    dist, pop, k, n = label_tag_distribution("city", i.profile, i.history, i.items), item_popularity(i.history), 3, 3
    got = _rows(recommend_by_label("city", dist, pop, i.items, i.profile, i.history, k, n, 4))
    lists = _brute_scores(select_tags(dist, "reside_city", k, 4), "reside_city", i.items, pop)
    seen = _seen(i.history)
    want = sorted((p.id, *row) for p in i.profile.collect()
                  for row in _ranked(lists.get(p.reside_city, []), seen.get(p.id, set()), n))
    assert got == want
