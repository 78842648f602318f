"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even if the aggregate after it then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Snapshot tables are partitioned by period; a write replaces only the
    # partitions it carries rows for.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Sessions are merged inside each input partition before the shuffle, so a
    # hot session key reaches its reducer as a few rows per task.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

_own_dirs: dict[str, str] = {}


def build_session(
    app: str = "tallyglass",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for staged tables and stream logs.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    app = context.applicationId
    if app not in _own_dirs:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="tallyglass-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

