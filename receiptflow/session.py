"""Session helpers: one place for the configuration every job relies on."""
from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a catalogue job wants on any cluster: AQE (runtime coalescing and
# skew-join splitting), UTC session time, Arrow for the few Python stages.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "receiptflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the catalogue defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it isn't installed there
    (the Python stages import it by name)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="receiptflow-pkg-")
    archive = os.path.join(folder, "receiptflow.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "receiptflow")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Only a local master, whose
    executors share the driver's disk, may do without: it gets a scratch folder
    that goes with the process.  Elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="receiptflow-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs inside leave no shuffle files: they go when the job has ended, not when the
    driver's garbage collection finds that nothing refers to them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before else spark.conf.unset(SHUFFLE_CLEANUP)


_WRITTEN: dict[int, list[str]] = {}


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: the lineage is cut, the data survives executor loss, and (unlike
    ``checkpoint()`` without a cache) the plan runs only once.  The files stay
    until :func:`drop_scratch` (or the checkpoint folder) goes; the shuffle files
    of the write go with it."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(id(spark.sparkContext), []).append(path)
    return spark.read.parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete everything :func:`materialize` wrote in this session so far; for a
    long-lived session, once the results that read it are written."""
    paths = _WRITTEN.pop(id(spark.sparkContext), [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
