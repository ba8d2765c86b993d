"""The generated TPC-H-like tables read as the three recommender inputs.

* history: ``lineitem`` joined to ``orders`` -> one event per order line:
  ``up_id = o_custkey``, ``video_id = l_partkey``, ``play_date = o_orderdate``.
* profile: ``customer`` joined to ``nation``: ``reside_city = n_name``,
  ``phone_type = c_mktsegment``.
* item tags: ``part`` -> ``lower(p_type), p_brand`` and the words of
  ``p_name`` as a comma-separated tag list.

Every frame is a projection of the Parquet files, so scans read only the
columns named here.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import Inputs, load_history, load_item_tags, load_profile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
            .select(F.col("o_custkey").alias("up_id"), F.col("l_partkey").alias("video_id"),
                    F.col("o_orderdate").alias("play_date")))


def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a second watch history: ``up_id = user_id``,
    ``video_id = event_type`` (string ids), ``play_date = ts`` (timestamp)."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("up_id"), F.col("event_type").alias("video_id"),
        F.col("ts").alias("play_date"))
    return load_history(events)


def events_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the second history's items: the event type and its first letter."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id")).distinct()
    return kinds.select("video_id", F.concat_ws(",", "video_id", F.substring("video_id", 1, 1))
                        .alias("video_second_class"))


def raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .select(F.col("c_custkey").alias("id"), F.col("n_name").alias("reside_city"),
                    F.col("c_mktsegment").alias("phone_type")))


def raw_item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    csv = F.concat_ws(",", F.lower("p_type"), F.col("p_brand"),
                      F.regexp_replace("p_name", " ", ","))
    return part.select(F.col("p_partkey").alias("video_id"), csv.alias("video_second_class"))


def testdata_inputs(spark: SparkSession, sf_dir: str, n_tags: int = 80) -> Inputs:
    return Inputs(load_profile(raw_profile(spark, sf_dir)),
                  load_history(raw_history(spark, sf_dir)),
                  load_item_tags(raw_item_tags(spark, sf_dir), n_tags))
