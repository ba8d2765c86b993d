"""Tag-affinity recommendation analytics on Spark DataFrames."""

from .operators.distribution import (dense_distribution, label_tag_distribution,
                                     user_tag_distribution)
from .operators.drift import kl_divergence, kl_summary, weekly_drift
from .operators.evaluate import evaluate_precision, holdout_split, recommendation_precision
from .operators.popularity import item_popularity
from .operators.recommend import (recommend_by_label, recommend_by_user,
                                  recommend_label_two_window, recommend_user_two_window)
from .operators.sampling import sample_tags, top_tags
from .plans.jobs import run_rec, run_stat, run_train
from .plans.views import register_views
from .session import build_session, cut_lineage, release, shared_dir
from .sources.inputs import Inputs, ItemTags, load_history, load_inputs, load_item_tags, load_profile

__all__ = [
    "Inputs", "ItemTags", "build_session", "cut_lineage", "dense_distribution", "evaluate_precision", "holdout_split",
    "item_popularity", "kl_divergence", "kl_summary", "label_tag_distribution",
    "load_history", "load_inputs", "load_item_tags", "load_profile", "recommend_by_label",
    "recommend_by_user", "recommend_label_two_window", "recommend_user_two_window",
    "recommendation_precision", "register_views", "release", "run_rec", "run_stat",
    "run_train", "sample_tags", "shared_dir", "top_tags", "user_tag_distribution",
    "weekly_drift",
]
