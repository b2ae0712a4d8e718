"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall-clock (key derivation and minute text
# are defined in UTC), AQE with skew-join splitting, and Arrow for the few
# Python batch parsers.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Skew splits and rebalanced writes aim at ~128 MB partitions.  AQE keeps
    # its parallelism-first coalescing (many folders are written in parallel).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts go through Arrow: small batches bound the memory of a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Keyed stream state (per phone, per e-mail) lives in RocksDB, off heap and
    # spilled to local disk, so state larger than executor memory is fine.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Uploads are many small files.  A list of paths is listed by few tasks (Spark's default is a task a path, up to 10,000),
    # and opening a file counts as 256 KB (default 4 MB, which makes a task of every 32 files).
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.files.openCostInBytes": "256k",
    # Rows of few bytes can cost much time (a folder a file, a document a group): small shuffles keep a task per core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _quiet_python_workers() -> None:
    # Python workers inherit the environment: hide pandas FutureWarnings raised
    # inside Spark's own Arrow serializer.
    os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "carelake", extra: dict | None = None) -> SparkSession:
    _quiet_python_workers()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Session-level SQL settings applied to an existing session.

    Sizes and switches that the deployment has set for its own hardware stay;
    the time zone and the overwrite mode are needed for right results.
    """
    given = spark.sparkContext.getConf()
    for k, v in DEFAULT_CONF.items():
        needed = k in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode")
        if k.startswith("spark.sql.") and k != "spark.sql.execution.arrow.pyspark.enabled" and (needed or not given.contains(k)):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a shared session
                pass
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: functions that run there are pickled by
    reference, and executors need not have the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_carelake_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="carelake-pkg-"), "carelake_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.join("carelake", os.path.relpath(f, top)))
    sc.addPyFile(path)
    sc._carelake_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared filesystem or object
    store).  Only when it is unset in local mode (one machine, as in tests) do
    we create one; elsewhere executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="carelake-ckpt-")
    sc.setCheckpointDir(conf)
    got = sc.getCheckpointDir() or conf
    return got.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = f"{root}/carelake-scratch/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of ``path`` (works for
    local, HDFS and object-store paths alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
