"""Registered queries over the generated test tables.

Every query reads the whole tables of ``sf_dir`` (no id subsets, no row
caps); windows and parameters below are fixed so that the Spark plan and the
SQL twin in ``oracle.py`` compute the same thing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kl import kl_dense
from ..operators import tags as tag_ops
from ..operators.distribution import (dense_distribution, label_tag_distribution,
                                      user_tag_distribution)
from ..operators.drift import kl_summary, user_drift, weekly_drift
from ..operators.evaluate import evaluate_precision, split_summary
from ..operators.popularity import item_popularity
from ..operators.recommend import (best_items, expand_label_to_users, label_candidates, label_cut, rank_top_n,
                                   recommend_label_two_window, recommend_label_window,
                                   recommend_user_two_window, recommend_user_window)
from ..operators.recommend import _label_people as label_people
from ..operators.sampling import sample_tags, top_tags
from ..sources.inputs import Inputs, load_item_tags
from ..sources.registry import Handle, InputRegistry
from ..sources.sinks import (distribution_table_name, enrich_and_save_recs, enrich_recommendations,
                             recommendation_table_name, save_distribution)
from ..sources.testdata import events_history, events_tags, testdata_inputs
from .jobs import recommendations, run_rec, run_stat, run_train

# Fixed query parameters (shared with oracle.py).
N_TAGS = 80                          # vector length D
K = 10                               # tags drawn per key
N = 5                                # items per user
SEED = 42
TO_DATE = dt.date(2001, 8, 1)        # last day of the generated history
WINDOW_DAYS = 28                     # recent window [TO_DATE - 28, TO_DATE]
RECENT_FROM = TO_DATE - dt.timedelta(days=WINDOW_DAYS)
DIST_FROM = dt.date(2001, 2, 1)      # distribution window [DIST_FROM, TO_DATE]
KL_SPLIT = dt.date(2001, 1, 1)       # KL: old = up to split, new = split .. TO_DATE
EVAL_DATE = dt.date(2001, 7, 1)      # precision: train <= EVAL_DATE <= test
WEEKS = 8
OFFSET_WEEKS = 0
ROUND = 6                            # digits kept for log-based doubles


REGISTRY = InputRegistry()
_HANDLES: dict[tuple, Handle] = {}


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The three inputs, loaded once per session and directory.

    Loading writes the item-tag tables to the shared folder and measures them,
    like a job that prepares its inputs once; measured sizes therefore belong
    to what later queries read, whatever happens to the source files.  The
    catalog's handle keeps the tables until ``close_inputs``.
    """
    place = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if place not in _HANDLES:
        _HANDLES[place] = REGISTRY.acquire(spark, sf_dir, lambda: testdata_inputs(spark, sf_dir, N_TAGS))
    return _HANDLES[place].inputs


def close_inputs(spark: SparkSession) -> None:
    """Give up the loaded inputs of this session: their tables go, the next query loads again."""
    own = (id(spark), spark.sparkContext.applicationId)
    for place in [p for p in _HANDLES if p[:2] == own]:
        _HANDLES.pop(place).close()


def q_profile_clean(spark, sf_dir):
    return _inputs(spark, sf_dir).profile


def q_history_clean(spark, sf_dir):
    return _inputs(spark, sf_dir).history


def q_tag_dictionary(spark, sf_dir):
    return _inputs(spark, sf_dir).items.dictionary


def q_item_tags_long(spark, sf_dir):
    return _inputs(spark, sf_dir).items.long.select("video_id", "tag", "tag_idx")


def q_item_multi_hot(spark, sf_dir):
    return _inputs(spark, sf_dir).items.dense()


def q_tag_index_list(spark, sf_dir):
    return tag_ops.tag_index_list(_inputs(spark, sf_dir).items.dense())


def q_item_popularity(spark, sf_dir):
    return item_popularity(_inputs(spark, sf_dir).history, RECENT_FROM, TO_DATE)


EVENTS_FROM, EVENTS_TO = dt.date(2024, 1, 8), dt.date(2024, 1, 28)


def q_item_popularity_events(spark, sf_dir):
    """Popularity over the second history (event types as items)."""
    return item_popularity(events_history(spark, sf_dir), EVENTS_FROM, EVENTS_TO)


def _label_dist(spark, sf_dir, label):
    i = _inputs(spark, sf_dir)
    return label_tag_distribution(label, i.profile, i.history, i.items, DIST_FROM, TO_DATE)


def q_tag_dist_city(spark, sf_dir):
    return _label_dist(spark, sf_dir, "city")


def q_tag_dist_phone(spark, sf_dir):
    return _label_dist(spark, sf_dir, "phone")


def _user_dist(i: Inputs, start=DIST_FROM, end=TO_DATE):
    return user_tag_distribution(i.history, i.items, start, end)


def q_tag_dist_user(spark, sf_dir):
    return _user_dist(_inputs(spark, sf_dir))


def q_tag_dist_user_dense(spark, sf_dir):
    return dense_distribution(_user_dist(_inputs(spark, sf_dir)), "up_id", N_TAGS)


def q_tag_dist_city_dense(spark, sf_dir):
    return dense_distribution(_label_dist(spark, sf_dir, "city"), "reside_city", N_TAGS)


def q_sampled_tags_user(spark, sf_dir):
    return sample_tags(_user_dist(_inputs(spark, sf_dir)), "up_id", K, SEED)


def q_sampled_tags_city(spark, sf_dir):
    return sample_tags(_label_dist(spark, sf_dir, "city"), "reside_city", K, SEED)


def q_top_tags_user(spark, sf_dir):
    return top_tags(_user_dist(_inputs(spark, sf_dir)), "up_id", K)


def q_top_tags_city(spark, sf_dir):
    return top_tags(_label_dist(spark, sf_dir, "city"), "reside_city", K)


SCORED = 20  # scored items reported per user


def _best_scored(i: Inputs, unseen: bool) -> DataFrame:
    selected = sample_tags(_user_dist(i, RECENT_FROM, TO_DATE), "up_id", K, SEED)
    best = best_items(selected, item_popularity(i.history, RECENT_FROM, TO_DATE), i.items, K, SCORED,
                      i.history if unseen else None)
    return best.select("up_id", "video_id", "prob_sum", "pop")


def q_score_items_user(spark, sf_dir):
    """Each user's best scored items, seen ones included."""
    return _best_scored(_inputs(spark, sf_dir), unseen=False)


def q_unseen_candidates(spark, sf_dir):
    """Each user's best scored items after the seen ones are excluded."""
    return _best_scored(_inputs(spark, sf_dir), unseen=True)


def _recommend_user(i: Inputs, mode="sample", ties="keep", start=RECENT_FROM):
    return recommend_user_window(i.history, i.items, start, TO_DATE, K, N, SEED, mode, ties)


def q_recommend_user(spark, sf_dir):
    return _recommend_user(_inputs(spark, sf_dir))


def q_recommend_user_top(spark, sf_dir):
    return _recommend_user(_inputs(spark, sf_dir), mode="top")


def q_recommend_user_break_ties(spark, sf_dir):
    return _recommend_user(_inputs(spark, sf_dir), ties="break")


def q_recommend_user_all(spark, sf_dir):
    """Interest and popularity over the whole history."""
    return _recommend_user(_inputs(spark, sf_dir), start=None)


def _recommend_label(spark, sf_dir, label, mode="sample", start=RECENT_FROM):
    i = _inputs(spark, sf_dir)
    return recommend_label_window(label, i.profile, i.history, i.items, start, TO_DATE, K, N, SEED, mode)


def q_recommend_city(spark, sf_dir):
    return _recommend_label(spark, sf_dir, "city")


def q_recommend_phone(spark, sf_dir):
    return _recommend_label(spark, sf_dir, "phone")


def q_recommend_city_top(spark, sf_dir):
    return _recommend_label(spark, sf_dir, "city", mode="top")


def q_recommend_city_all(spark, sf_dir):
    """Interest and popularity over the whole history."""
    return _recommend_label(spark, sf_dir, "city", start=None)


def q_label_expanded(spark, sf_dir):
    """Each user's best rows of its city's list, before seen items are excluded."""
    i = _inputs(spark, sf_dir)
    dist = label_tag_distribution("city", i.profile, i.history, i.items, RECENT_FROM, TO_DATE)
    people = label_people("city", i.profile, i.history, None)
    cand = label_candidates("city", dist, item_popularity(i.history, RECENT_FROM, TO_DATE), i.items, K,
                            label_cut("city", people, N), SEED)
    out = expand_label_to_users("city", cand, people, N)
    return rank_top_n(out, N).select("up_id", "video_id", "prob_sum", "pop", "rank")


def q_recommend_user_two_window(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return recommend_user_two_window(i.history, i.items, K, N, TO_DATE, WINDOW_DAYS, SEED)


def _label_two_window(spark, sf_dir, label):
    i = _inputs(spark, sf_dir)
    return recommend_label_two_window(label, i.profile, i.history, i.items, K, N, TO_DATE,
                                      WINDOW_DAYS, SEED)


def q_recommend_city_two_window(spark, sf_dir):
    return _label_two_window(spark, sf_dir, "city")


def q_recommend_phone_two_window(spark, sf_dir):
    return _label_two_window(spark, sf_dir, "phone")


def q_holdout_split(spark, sf_dir):
    """Per part: events, users, items and date range of the split."""
    return split_summary(_inputs(spark, sf_dir).history, EVAL_DATE, WINDOW_DAYS)


def _precision(spark, sf_dir, label, split="code"):
    i = _inputs(spark, sf_dir)
    return evaluate_precision(label, i.profile, i.history, i.items, K, N, EVAL_DATE,
                              WINDOW_DAYS, SEED, split=split)


def q_precision_user(spark, sf_dir):
    return _precision(spark, sf_dir, "user")


def q_precision_city(spark, sf_dir):
    return _precision(spark, sf_dir, "city")


def q_precision_phone(spark, sf_dir):
    return _precision(spark, sf_dir, "phone")


def q_precision_user_holdout(spark, sf_dir):
    return _precision(spark, sf_dir, "user", "holdout")


def _kl(i: Inputs, direction="old_new"):
    return user_drift(i.history, i.items, (None, KL_SPLIT), (KL_SPLIT, TO_DATE), direction)


def q_kl_user(spark, sf_dir):
    kl = _kl(_inputs(spark, sf_dir))
    return kl.select("up_id", F.round("kl", ROUND).alias("kl"))


def q_kl_user_reverse(spark, sf_dir):
    kl = _kl(_inputs(spark, sf_dir), "new_old")
    return kl.select("up_id", F.round("kl", ROUND).alias("kl"))


def q_kl_user_dense(spark, sf_dir):
    """The dense-array form of the KL operator (same values as ``kl_user``)."""
    i = _inputs(spark, sf_dir)
    old = dense_distribution(user_tag_distribution(i.history, i.items, None, KL_SPLIT),
                             "up_id", N_TAGS)
    new = dense_distribution(user_tag_distribution(i.history, i.items, KL_SPLIT, TO_DATE),
                             "up_id", N_TAGS).withColumnRenamed("prob", "q")
    kl = old.join(new, "up_id").select("up_id", kl_dense(F.col("prob"), F.col("q")).alias("kl"))
    return kl.select("up_id", F.round("kl", ROUND).alias("kl"))


def q_kl_summary(spark, sf_dir):
    s = kl_summary(_kl(_inputs(spark, sf_dir)))
    return s.select("n_users", "n_undefined",
                    *[F.round(c, ROUND).alias(c) for c in ("kl_min", "kl_max", "kl_avg", "kl_var")])


def _drift_rows(s: DataFrame) -> DataFrame:
    return s.select("week", "week_start", "week_end", "n_users", "n_undefined",
                    *[F.round(c, ROUND).alias(c) for c in ("kl_min", "kl_max", "kl_avg", "kl_var")])


def q_weekly_drift(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return _drift_rows(weekly_drift(i.history, i.items, TO_DATE, WEEKS, OFFSET_WEEKS))


SHIFTED_WEEKS, SHIFT = 5, 3
GAP_DATE, GAP_WEEKS = dt.date(2001, 9, 12), 9   # the newest windows lie after the last event
WINDOW_LENGTH, WINDOWS = 10, 4
EVENT_WEEKS = 4


def q_weekly_drift_offset(spark, sf_dir):
    """Weeks that end ``SHIFT`` weeks before the date, KL in the other direction."""
    i = _inputs(spark, sf_dir)
    return _drift_rows(weekly_drift(i.history, i.items, TO_DATE, SHIFTED_WEEKS, SHIFT, "new_old"))


def q_weekly_drift_gaps(spark, sf_dir):
    """One row per requested week, empty ones too."""
    i = _inputs(spark, sf_dir)
    return _drift_rows(weekly_drift(i.history, i.items, GAP_DATE, GAP_WEEKS))


def q_drift_windows(spark, sf_dir):
    """Windows of another length than a week."""
    i = _inputs(spark, sf_dir)
    return _drift_rows(weekly_drift(i.history, i.items, TO_DATE, WINDOWS, window_days=WINDOW_LENGTH))


def q_weekly_drift_events(spark, sf_dir):
    """Drift over the second history."""
    items = load_item_tags(events_tags(spark, sf_dir), N_TAGS)
    return _drift_rows(weekly_drift(events_history(spark, sf_dir), items, EVENTS_TO, EVENT_WEEKS))


def q_saved_distribution(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return save_distribution(_user_dist(i), "user")


def q_saved_distribution_table(spark, sf_dir):
    """O26 into the catalog, read back by its name."""
    save_distribution(_user_dist(_inputs(spark, sf_dir)), "user", table=True)
    return spark.table(distribution_table_name("user"))


def q_saved_distribution_city(spark, sf_dir):
    return save_distribution(_label_dist(spark, sf_dir, "city"), "city")


def q_saved_distribution_dense(spark, sf_dir):
    return save_distribution(_label_dist(spark, sf_dir, "phone"), "phone", form="dense", n_tags=N_TAGS)


def q_enriched_recs(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return enrich_recommendations(_recommend_user(i), i.items)


def _saved_recs(spark, sf_dir, label):
    i = _inputs(spark, sf_dir)
    recs = recommendations(i, label, K, N, TO_DATE, WINDOW_DAYS, SEED)
    return enrich_and_save_recs(recs, i.items, label)


def q_saved_recs_user(spark, sf_dir):
    """The two-window list joined to item tags, written and read back."""
    return _saved_recs(spark, sf_dir, "user")


def q_saved_recs_table(spark, sf_dir):
    """O27 into the catalog; then by name: how likely each user finds the tags of its list."""
    i = _inputs(spark, sf_dir)
    save_distribution(_user_dist(i), "user", table=True)
    enrich_and_save_recs(_recommend_user(i), i.items, "user", table=True)
    recs, dist = spark.table(recommendation_table_name("user")), spark.table(distribution_table_name("user"))
    listed = recs.groupBy("up_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("rank").alias("last_rank"))
    events = dist.groupBy("up_id").agg(F.sum("n").alias("tag_events"))
    return listed.join(events, "up_id")


def q_saved_recs_city(spark, sf_dir):
    return _saved_recs(spark, sf_dir, "city")


def q_job_rec(spark, sf_dir):
    return run_rec(_inputs(spark, sf_dir), "phone", K, N, TO_DATE, WINDOW_DAYS, SEED)


def q_job_train(spark, sf_dir):
    """The stored distribution's totals next to the precision of the same run."""
    i = _inputs(spark, sf_dir)
    stored, precision = run_train(i, "city", K, N, DIST_FROM, EVAL_DATE, WINDOW_DAYS, SEED)
    p = precision.first()  # one row
    return stored.agg(F.count(F.lit(1)).alias("rows_stored"), F.sum("n").alias("events_stored"),
                      F.lit(p["hits"]).cast("bigint").alias("hits"),
                      F.lit(p["recommended"]).cast("bigint").alias("recommended"),
                      F.lit(p["precision"]).cast("double").alias("precision"))


def q_job_stat(spark, sf_dir):
    return _drift_rows(run_stat(_inputs(spark, sf_dir), TO_DATE, SHIFTED_WEEKS))


_ALL = (
    q_profile_clean, q_history_clean, q_tag_dictionary, q_item_tags_long, q_item_multi_hot, q_tag_index_list,
    q_item_popularity, q_item_popularity_events, q_tag_dist_city, q_tag_dist_phone, q_tag_dist_user,
    q_tag_dist_user_dense, q_tag_dist_city_dense, q_sampled_tags_user, q_sampled_tags_city, q_top_tags_user,
    q_top_tags_city, q_score_items_user, q_unseen_candidates, q_recommend_user, q_recommend_user_top,
    q_recommend_user_break_ties, q_recommend_user_all, q_recommend_city, q_recommend_phone, q_recommend_city_top,
    q_recommend_city_all, q_label_expanded, q_recommend_user_two_window, q_recommend_city_two_window,
    q_recommend_phone_two_window, q_holdout_split, q_precision_user, q_precision_city, q_precision_phone,
    q_precision_user_holdout, q_kl_user, q_kl_user_reverse, q_kl_user_dense, q_kl_summary, q_weekly_drift,
    q_weekly_drift_offset, q_weekly_drift_gaps, q_drift_windows, q_weekly_drift_events, q_saved_distribution,
    q_saved_distribution_city, q_saved_distribution_dense, q_enriched_recs, q_saved_recs_user, q_saved_recs_city,
    q_saved_distribution_table, q_saved_recs_table,
    q_job_rec, q_job_train, q_job_stat)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__[2:]: f for f in _ALL}
