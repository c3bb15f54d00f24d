"""Spark session settings the library relies on.

All operators are plain DataFrame plans; the only settings that change
results are the session time zone (timestamps are tz-naive wall-clock
values and ``date_trunc`` on TIMESTAMP_NTZ goes through the session zone)
and ANSI mode.  The rest are throughput settings that a cluster
deployment normally supplies itself; ``get_session`` only fills in what
is not already configured.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that affect correctness: applied to every session we touch.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Throughput settings for local runs (tests, bench).  On a cluster the
# cluster's own configuration is left untouched.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the correctness settings to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fleetlog", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them ``None``: then only the correctness settings are applied
    and every throughput setting stays as the cluster configured it.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(REQUIRED_CONF)
    if master:
        builder = builder.master(master)
        conf = {**LOCAL_CONF, **conf}
    for key, value in conf.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming state: ``spark.checkpoint.dir``,
    used as configured, scheme and all.

    Only where none is set and there is a single machine (a local run or a test) a
    private folder is made; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fleetlog-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (for written intermediate tables)."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlog/{name}-{uuid.uuid4().hex[:12]}"
