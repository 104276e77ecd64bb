"""Session helpers: one place for the Spark settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "streamsift") -> SparkSession:
    """Return (or build) a session tuned for the operators in this package.

    Only used by tests, bench and examples; library functions take the
    caller's session and never change its global settings except for a
    missing checkpoint directory (see ``checkpoint_dir``).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("SHUFFLE_PARTITIONS", cpus))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir`` if set.

    Only when nothing is configured and the master is local (tests) a fresh
    scratch folder is created. On a cluster a folder of one machine would be
    invisible to the others, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="streamsift-ckpt-", dir=os.environ.get("STREAMSIFT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``streamsift`` importable in executor Python workers.

    The package is zipped once per application into the shared checkpoint
    folder and registered with ``addPyFile`` (the programmatic --py-files),
    so pandas UDFs that call package helpers work on any cluster.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = checkpoint_dir(spark)
    target = f"{base.rstrip('/')}/pyfiles-{uuid.uuid4().hex[:8]}"
    local_base = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local_base:  # remote shared folder: zip locally, let Spark upload it
        local_base = tempfile.mkdtemp(prefix="streamsift-pkg-")
    os.makedirs(local_base, exist_ok=True)
    archive = shutil.make_archive(os.path.join(local_base, "streamsift"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder + package shipping; called at every public entry."""
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_CUTS = [0]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, compression: str | None = None):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder.

    One write job, then a fresh scan: the plan restarts from durable files
    (survives executor loss, unlike a local checkpoint) and the optimizer
    sees real sizes for the next join. Shuffle files of the write go when it
    ends; nothing reads them again. ``compression`` overrides the session's codec.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    _CUTS[0] += 1
    path = f"{base.rstrip('/')}/cut-{os.getpid()}-{uuid.uuid4().hex[:12]}-{_CUTS[0]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def release(df) -> None:
    """Delete the tables of ``cut_lineage`` that ``df`` reads; afterwards neither
    it nor another frame over them can be read."""
    spark = df.sparkSession
    found = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in found:
        if folder.rsplit("/", 1)[-1].startswith(f"cut-{os.getpid()}-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
