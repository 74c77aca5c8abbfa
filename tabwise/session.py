"""Session helpers.

The library itself never creates a session: every public function takes a
``DataFrame`` (or a ``SparkSession``) from the caller.  ``local_session`` is
only for tests, the bench and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  ANSI stays on (Spark 4 default): every
# division in the library goes through ``try_divide`` or a guarded CASE.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of ranks / de-duplicated tables are deleted once their
    # DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tabwise") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TABWISE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder comes from the cluster configuration and is
    shared storage; without one this raises.  Only a local session (one
    machine, as in tests) gets a scratch folder when nothing is configured.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tabwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - Spark Connect: the server-side setting applies
        pass
    return d


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read back. Unlike a
    checkpoint, whose plan keeps the size estimates of everything that led to
    it, the table tells the planner its true size. The files go with the
    session."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tabwise-written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    except AttributeError:  # Spark Connect: the server has no such handle
        pass
    return spark.read.parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for explicit range exchanges: the shuffle setting,
    never below the cluster's core count."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        n = max(n, spark.sparkContext.defaultParallelism)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return n
