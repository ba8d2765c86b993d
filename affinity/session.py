"""Session settings the operators are planned against, and the shared folder.

The library never builds a session behind the caller's back; ``build_session``
is a convenience for tests, the bench and local runs.  On a cluster the same
settings belong in ``spark-defaults.conf``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package is designed around; none changes a result.
#  * AQE re-plans joins at runtime from real shuffle sizes, coalesces small
#    partitions and splits large join partitions.  With the factor at 0 every
#    partition above the size threshold is split, not only one far above the
#    median: a join on a few keys (tags, labels) still fills the cluster.
#  * Shuffles start from many partitions that AQE merges up to 8 MB (not 64 MB):
#    a task's hash maps and sorts hold a multiple of what it reads, so its memory
#    stays the same while the number of tasks grows with the input.
#  * Spark's own broadcasts go by compressed file bytes: 10 MB of a narrow Parquet
#    table may hold millions of rows, too many for the driver.  Below 256 KB they
#    may; anything larger is broadcast only where ``functions.joins`` measured it.
#  * requireAllClusterKeysForCoPartition=false lets a join on (user, item)
#    reuse a partitioning on user alone: candidates are produced partitioned by
#    user and the seen-history side is repartitioned by user, so the
#    user x item candidate volume is never shuffled again.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "affinity", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.ui.retainedExecutions", "20")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**PLAN_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in PLAN_CONF.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written tables.

    Read from ``spark.checkpoint.dir`` as the cluster configures it.  Where it
    is unset, a local session (tests) gets a fresh scratch folder; on a cluster
    executors could not see one, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="affinity-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table (its scheme is kept)."""
    return f"{shared_dir(spark)}/affinity/{name}-{uuid.uuid4().hex}"


# Folders written by ``cut_lineage``, by application; ``release`` deletes them.
_CUTS: dict[str, list[str]] = {}
# Of these, how many holders each has; a folder with one is in use and stays.
_HELD: dict[str, Counter] = {}


def written(spark: SparkSession) -> int:
    """How many intermediates this application has written and not released."""
    return len(_CUTS.get(spark.sparkContext.applicationId, []))


@contextmanager
def recorded(spark: SparkSession) -> Iterator[list[str]]:
    """The folders that ``cut_lineage`` writes inside the block, known at its end."""
    cuts = _CUTS.setdefault(spark.sparkContext.applicationId, [])
    known, paths = set(cuts), []
    yield paths
    paths.extend(p for p in cuts if p not in known)


def hold(spark: SparkSession, paths: list[str]) -> None:
    """Keep folders over ``release`` until as many ``let_go`` follow."""
    _HELD.setdefault(spark.sparkContext.applicationId, Counter()).update(paths)


def let_go(spark: SparkSession, paths: list[str]) -> None:
    """End one ``hold``; folders that nobody holds any more are deleted."""
    app = spark.sparkContext.applicationId
    held, cuts = _HELD.get(app, Counter()), _CUTS.get(app, [])
    held.subtract(paths)
    free = [p for p in paths if held[p] <= 0]
    for path in free:
        held.pop(path, None)
        if path in cuts:
            cuts.remove(path)
    _delete(spark, free)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediates that this application's plans wrote and nobody holds.

    For long-lived sessions, between jobs: frames returned before must have
    been written or collected.  ``since``, a count from ``written``, keeps the
    older ones.  Loaded inputs (``sources.registry``) are held and stay, as do
    the caller's own caches.
    """
    app = spark.sparkContext.applicationId
    cuts, held = _CUTS.get(app, []), _HELD.get(app, Counter())
    free = [p for p in cuts[since:] if held[p] <= 0]
    _delete(spark, free)
    cuts[since:] = [p for p in cuts[since:] if held[p] > 0]


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Later stages read the stored Parquet (with file statistics for the
    planner) instead of depending on its lineage, so losing executors after
    this point never re-runs the plan that produced it.  Eager (one job).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)
