"""Temp views for SQL users.

The reference registered its probability aggregate for use from SQL; here
SQL users get the inputs and the long distributions as views and write
ordinary SQL (``n / total`` is the probability, ``sum`` over a key is the
distribution's total).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.distribution import label_tag_distribution, user_tag_distribution
from ..sources.inputs import Inputs


def register_views(inputs: Inputs, start=None, end=None, prefix: str = "") -> dict[str, DataFrame]:
    """Register history, profile, item tags, dictionary and distributions.

    View names: ``<prefix>history``, ``<prefix>profile``, ``<prefix>item_tags``
    (long form), ``<prefix>tag_dictionary``, ``<prefix>user_tag_dist``,
    ``<prefix>city_tag_dist``, ``<prefix>phone_tag_dist`` (distributions
    over ``[start, end]``).  Returns the frames by view name.
    """
    frames = {
        "history": inputs.history,
        "profile": inputs.profile,
        "item_tags": inputs.items.long,
        "tag_dictionary": inputs.items.dictionary,
        "user_tag_dist": user_tag_distribution(inputs.history, inputs.items, start, end),
        "city_tag_dist": label_tag_distribution("city", inputs.profile, inputs.history,
                                                inputs.items, start, end),
        "phone_tag_dist": label_tag_distribution("phone", inputs.profile, inputs.history,
                                                 inputs.items, start, end),
    }
    out = {}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
        out[prefix + name] = df
    return out
