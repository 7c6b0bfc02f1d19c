"""Spark session settings shared by jobs, tests and the bench.

Every job reads these settings from the session it is given; ``get_spark`` only
builds a session when none exists (tests, bench, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators rely on for correct results.
REQUIRED_CONF = {
    # all timestamps are compared and rendered in UTC
    "spark.sql.session.timeZone": "UTC",
    # mail headers: the last duplicate wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings for scale: AQE re-plans joins and shuffles at run time. Broadcast joins are
# chosen only from measured sizes: the planner's estimate-based broadcast is off, and
# AQE turns a join into a broadcast join once the finished shuffle stage of one side is
# under the adaptive threshold.
SCALE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files are removed once their data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "quire", shuffle_partitions: int | None = None,
              **extra: str) -> SparkSession:
    """Return the active session, or build one with the settings above.

    Under ``spark-submit`` (the JVM gateway already runs) the submitter's master and
    settings win: only the result-relevant settings are forced, and scale settings fill
    in what was not given. Otherwise a local session is built (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_required(active)
        return active
    from pyspark import SparkConf
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    given = SparkConf()
    b = SparkSession.builder.appName(app)
    if not submitted:
        b = b.master(master or os.environ.get("QUIRE_MASTER", "local[*]"))
        b = b.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
    for k, v in SCALE_CONF.items():
        if not (submitted and given.contains(k)):
            b = b.config(k, v)
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required(spark: SparkSession) -> None:
    """Set the settings that results depend on (idempotent, session-level)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder and is taken from the session. Only a
    local-mode session (tests) without one gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path
