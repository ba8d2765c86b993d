"""Writers for the stored outputs.

Both overwrite a Parquet table: a catalog table when ``table`` is given, else
``path``; without either, a path of its own per run below the shared folder
(``spark.checkpoint.dir``), so that two runs never overwrite each other.  The
returned frame reads the written files back, so downstream work starts from
the stored table instead of re-running the lineage.

Catalog tables are bucketed and sorted by their key, so that reading two of
them back by name joins on the key without an exchange.  A new version is
written whole into a folder of its own before the name moves to it: readers
see the old table or the new one, and a failed run leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.distribution import dense_distribution
from ..session import scratch_path
from ..sources.inputs import ItemTags, label_column


# The table names must equal the reference's.
def distribution_table_name(label: str) -> str:
    """``user`` -> UserTagDistribution, ``city`` -> cityTagDistribution, ..."""
    if label == "user":
        return "UserTagDistribution"
    label_column(label)
    return f"{label}TagDistribution"


def recommendation_table_name(label: str) -> str:
    if label == "user":
        return "RecommendationBasedOnUserInterest"
    label_column(label)
    return f"RecommendationBasedOn{label}"


# Buckets of a catalog table; tables that are to be joined in place share the number.
BUCKETS_CONF, BUCKETS = "spark.affinity.tableBuckets", 32


def write_table(df: DataFrame, name: str, table: bool = False, path: str | None = None,
                key: str | None = None) -> DataFrame:
    """Write ``df`` and read it back, by ``name`` with ``table``, else by path.

    ``key`` is the column that a catalog table is bucketed and sorted by.
    Catalog tables are external, in a fresh folder below the shared one, unless
    ``path`` names an empty one.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    if not table:
        df.write.mode("overwrite").parquet(target)
        return spark.read.parquet(target)
    writer = df.write.format("parquet").option("path", target)
    if key is not None:
        buckets = int(spark.conf.get(BUCKETS_CONF, str(BUCKETS)))
        # one task per bucket, else each task leaves a file in every bucket
        writer = (df.repartition(buckets, key).write.format("parquet").option("path", target)
                  .bucketBy(buckets, key).sortBy(key))
    stage = f"{name}_{uuid.uuid4().hex}"
    writer.saveAsTable(stage)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"ALTER TABLE `{stage}` RENAME TO `{name}`")
    return spark.table(name)


def save_distribution(dist: DataFrame, label: str, table: bool = False, path: str | None = None,
                      form: str = "long", n_tags: int | None = None) -> DataFrame:
    """Overwrite the distribution table for ``label``.

    ``form='long'`` stores one row per tag of the support; ``'dense'`` the
    reference's ``(key, prob ARRAY<DOUBLE>)`` of length ``n_tags``.
    """
    key = "up_id" if label == "user" else label_column(label)
    if form == "dense":
        dist = dense_distribution(dist, key, n_tags)
    elif form != "long":
        raise ValueError(f"form must be 'long' or 'dense', got {form!r}")
    return write_table(dist, distribution_table_name(label), table, path, key)


def enrich_recommendations(recs: DataFrame, items: ItemTags) -> DataFrame:
    """Recommendations joined to each item's multi-hot tag vector (one row per tag row)."""
    return recs.join(items.dense(), "video_id")


def enrich_and_save_recs(recs: DataFrame, items: ItemTags, label: str, table: bool = False,
                         path: str | None = None) -> DataFrame:
    """Overwrite the enriched recommendation table for ``label``."""
    return write_table(enrich_recommendations(recs, items), recommendation_table_name(label),
                       table, path, "up_id")
