"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: runtime re-planning (AQE) for partition
# coalescing, skew splitting and broadcast conversion with a measured size,
# UTC so timestamps agree across engines, no web UI.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows can be megabytes; keep Arrow batches to Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "spindex", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the package defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests and the
    bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``spindex`` importable in Python workers (pandas UDFs).

    Zips the package once per SparkContext and registers it with
    ``addPyFile``, which distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    # deployments that ship the package themselves (--py-files) turn this off
    if spark.conf.get("spark.spindex.shipPackage", "true").lower() == "false":
        _SHIPPED.add(key)
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spindex-pkg-"), "spindex.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("spindex", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def small_batches(spark: SparkSession) -> None:
    """Hold the rows of an Arrow batch down in a session that others made: what a Python worker
    keeps then follows these few rows, not the size of its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(_DEFAULTS[key]):
        spark.conf.set(key, _DEFAULTS[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory named by the cluster (``spark.checkpoint.dir``).

    Only when the session leaves it unset (local tests) a fresh scratch folder
    is created; on a cluster the shared folder from the configuration is used.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="spindex-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def at_once(*jobs):
    """Run independent actions (functions without arguments) from threads of their own, so that Spark can
    work on all of them; returns their results in order.  The first error is raised when all have ended."""
    from concurrent.futures import ThreadPoolExecutor
    from pyspark import inheritable_thread_target
    spark = SparkSession.getActiveSession()
    wrap = inheritable_thread_target(spark) if spark is not None else inheritable_thread_target
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(wrap(job)) for job in jobs]
    return [r.result() for r in running]


def materialize(df, name: str = "table", partition_by: list[str] | None = None, sort_by: list[str] | None = None):
    """Write ``df`` once as Parquet under the cluster's checkpoint folder and
    return a DataFrame reading it back.

    This cuts lineage (later stages and retries read the written files, not
    the upstream plan) with a single computation of ``df``; an RDD-level
    checkpoint would compute an uncached plan twice.  The folder comes from
    ``spark.checkpoint.dir``, so it is shared storage on a cluster.
    """
    import uuid
    spark = df.sparkSession
    if partition_by:  # a partition value in few files, split by size: their number follows the data, not the tasks
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        if sort_by:
            df = df.sortWithinPartitions(*partition_by, *sort_by)
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    if partition_by:
        return spark.read.parquet(path).select(*df.columns)
    return spark.read.schema(df.schema).parquet(path)
