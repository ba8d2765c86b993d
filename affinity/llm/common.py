"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.session import cut_lineage


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    Covers sessions whose executors see the same path but were started without
    it on PYTHONPATH; elsewhere ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark (any file system)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back (survives lost executors)."""
    return cut_lineage(df, name)


def arrow_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]],
               schema: pa.Schema, spark_schema: str) -> DataFrame:
    """Apply ``fn`` (columns in, columns out) to each Arrow batch of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict())
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    return df.mapInArrow(run, spark_schema)


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of an undirected edge list with its smallest reachable node.

    ``edges`` has two BIGINT columns ``u`` and ``v``.  Returns ``node, component``
    for every node that occurs in an edge between two different nodes; self
    loops, repeated edges and rows with a null end add nothing, an empty edge
    list gives an empty result.

    Alternating large-star and small-star steps: each step is a grouped minimum
    (map-side combined) and an equi-join on the node, both sides of which are
    plain shuffles, so AQE splits the partition of a hub.  The state after each
    step is a written table in the shared folder; the driver sees only a count
    and a checksum per round.  Rounds grow with the logarithm of the longest
    path, not with the number of nodes.
    """
    state = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "cc-edges")
    seen = _fingerprint(state)
    while seen[0]:
        # large star: every neighbour above u moves to the smallest node around u
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = cut(both.join(low.hint("merge"), "u").where("v > u AND v <> m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # small star: u and all its neighbours below it move to the smallest of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = (large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        state = cut(small, "cc-small")
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    return (state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(state.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")))
