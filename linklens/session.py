"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Only settings that change results or that protect against skew; sizing
# (executors, memory, shuffle partitions) belongs to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "linklens", cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, **LOCAL_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str = "stage") -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. Where it is unset, a local
    master gets one temporary folder, removed at exit; on a cluster, where a local
    folder would not be shared, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
    return f"{root.rstrip('/')}/linklens/{label}-{uuid.uuid4().hex}"


_ROOT: list[str] = []
_ROOT_LOCK = threading.Lock()


def _local_root(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _ROOT_LOCK:
        if not _ROOT:
            _ROOT.append(tempfile.mkdtemp(prefix="linklens-"))
            atexit.register(shutil.rmtree, _ROOT[0], ignore_errors=True)
    return _ROOT[0]


def stage(df, label: str = "stage"):
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches consume one expensive intermediate: the table
    survives executor loss and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class once:
    """A property that is built once per object, also when several threads ask for it."""

    def __init__(self, build: Callable):
        self.build, self.name = build, build.__name__

    def __get__(self, owner, kind=None):
        if owner is None:
            return self
        known = owner.__dict__
        lock = known.setdefault(f"_lock_{self.name}", threading.RLock())
        with lock:
            if self.name not in known:
                known[self.name] = self.build(owner)
        return known[self.name]


def together(*steps: Callable[[], object]) -> list:
    """Submit independent jobs at the same time, so small ones do not leave the cluster idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [future.result() for future in [pool.submit(step) for step in steps]]
