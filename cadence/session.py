"""Session settings the operators rely on.

Only settings that change *results* are forced (session time zone). Everything
else (shuffle partitions, AQE knobs) is filled in only when the session does not
already carry a value, so a cluster's own configuration wins.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Results depend on these: timestamps are rendered and truncated in UTC.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
}

# Set where the session has no value of its own. The JVM never compiles a method of more than
# 8000 bytes; Spark's default limit (65535) lets wide projections, such as interpolated and
# rounded columns, become one and run interpreted.
FILLED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Defaults for a session we create ourselves; never override a cluster's values.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "cadence", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the pinned settings applied.

    ``master``/``partitions`` are only used when a new local session is built
    (tests, bench); on a cluster the submitted configuration is kept.
    """
    active = SparkSession.getActiveSession()
    if active is None:
        b = SparkSession.builder.appName(app)
        if master:
            b = b.master(master)
        for k, v in DEFAULTS.items():
            b = b.config(k, v)
        if partitions:
            b = b.config("spark.sql.shuffle.partitions", str(partitions))
        for k, v in (extra or {}).items():
            b = b.config(k, v)
        active = b.getOrCreate()
    return pin(active)


def pin(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a given session, and those of FILLED it does not carry."""
    for k, v in PINNED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    for k, v in FILLED.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


_WRITTEN: list[str] = []


def written_path(spark: SparkSession, sub: str) -> str:
    """A fresh path in the shared folder for a table that a query writes on its way;
    :func:`drop_written` deletes them all."""
    path = checkpoint_dir(spark, sub)
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that queries of this process have written on their way.
    To be called when their results are no longer read; otherwise they stay until
    the process ends."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop_written(spark)


_SHIPPED: set = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, as
    ``--py-files`` would: they need not run in the folder of the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-ship-"), "cadence.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession, sub: str | None = None) -> str:
    """Shared folder for lineage cuts and streaming state.

    Read from ``spark.checkpoint.dir`` (the cluster names it). Only when unset
    on a local master, as in tests, a fresh local folder is made and
    registered; a cluster without a shared folder is an error, never a
    machine-local fallback.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="cadence-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    if sub is None:
        return base
    return os.path.join(base, f"{sub}-{uuid.uuid4().hex[:12]}")
