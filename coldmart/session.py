"""Session settings, and where a job may cut its lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings every plan relies on; all of them can be set on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join against a dimension keeps a hot device on one shuffle partition; AQE
    # splits that partition and replicates the (small) dimension side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Read splits no larger than one task's memory share, whatever the file sizes.
    "spark.sql.files.maxPartitionBytes": "128m",
    # Stream state with timers lives in RocksDB, outside the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "coldmart", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_local_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder of this machine; on a
    cluster that would lose whatever is written there together with the node.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="coldmart-")
        atexit.register(shutil.rmtree, _local_folders[application], ignore_errors=True)
    return _local_folders[application]


def staged(df: DataFrame, name: str, cluster_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Used where several consumers would otherwise each repeat the same shuffle. Unlike
    an in-memory checkpoint the table outlives executors, and each consumer still reads
    only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/coldmart/{name}-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    df.write.mode("errorifexists").parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far(spark: SparkSession) -> int:
    return len(_staged.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0) -> None:
    """Delete what ``staged`` wrote from the ``since``-th table on, once nothing reads it."""
    paths = _staged.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del paths[since:]
