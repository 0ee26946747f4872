"""Session helpers: a local session for tests/bench, table registration and
the shared folder for written tables and checkpoints."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "grainline") -> SparkSession:
    """A local session configured the way the library expects (tests, bench)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # local filesystem: list day partitions on the driver instead of a listing job
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "100000")
        .getOrCreate()
    )


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each ``<sf_dir>/<name>.parquet`` as a temp view of that name."""
    for name in names:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            spark.read.parquet(path).createOrReplaceTempView(name)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder: the base of ``spark.checkpoint.dir``.

    Read from the session. ``getCheckpointDir()`` adds a per-application
    subfolder, so its parent is used. Only on a local master, where all tasks
    see the machine's folders, a fresh temporary folder is made if none is set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/").rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="grainline-")
    sc.setCheckpointDir(base)
    return base


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """Fingerprint of the files under a source folder: paths, sizes and times."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]
