"""Session construction and the shared work folder.

Timestamps are rendered to text inside ``trip_id`` (see functions.keys), so the
session zone is pinned to UTC. AQE stays on: it coalesces small shuffle
partitions, splits skewed ones and re-plans joins from runtime sizes.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "strata",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the settings the operators rely on.

    On a cluster, leave ``master`` unset and let the launcher decide; the
    shuffle partition count is then left to AQE coalescing.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Settings that may be changed on a running session.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _configured_checkpoint_dir(spark: SparkSession) -> str | None:
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    try:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - e.g. Spark Connect has no context
        value = None
    if value:
        return value
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover
        return None


def shared_dir(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A folder every executor can read and write.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (a shared
    file system or object store). Only when the session names none, as in
    local tests, a fresh temporary folder is created and registered as the
    checkpoint folder, so ``DataFrame.checkpoint()`` lands there too.
    """
    base = _configured_checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strata-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = "/".join([base.rstrip("/"), "strata", *parts])
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file://", "").replace("file:", ""), exist_ok=True)
    return path
