"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter for the operators in this package.  AQE re-plans
# joins at runtime (broadcast only when the measured side is under the
# threshold, split skewed partitions of sort-merge joins) and coalesces the
# many small post-aggregation partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "glossa", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the package defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder used to cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  A fallback is only
    applied when the setting is absent (tests, single-machine runs).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        d = fallback
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def local_fallback_dir() -> str:
    """Scratch folder for local runs only (never used when the cluster names one)."""
    import tempfile
    return tempfile.mkdtemp(prefix="glossa-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``glossa`` importable by the Python workers of this application
    (pandas UDFs and ``mapInPandas`` functions reference it): the package is
    zipped once and distributed with ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    import tempfile
    import glossa
    pkg = os.path.dirname(os.path.abspath(glossa.__file__))
    out = tempfile.mkdtemp(prefix="glossa-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "glossa"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir="glossa")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


_TIDIED = {"at": 0.0}


def tidy(spark: SparkSession, every: float = 6.0) -> None:
    """Asks the driver to collect its garbage, unless that was done in the last ``every`` seconds.  Shuffle files and
    broadcasts of finished jobs are removed only then, and a heap that was filled by plans and task figures is
    given back, so that steps of one run don't add up on disk and in the driver's memory."""
    import gc
    import time
    if time.monotonic() - _TIDIED["at"] < every:
        return
    gc.collect()                    # what Python still holds of the JVM's tables in cycles
    spark._jvm.System.gc()
    _TIDIED["at"] = time.monotonic()
