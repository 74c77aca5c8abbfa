"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF, CR.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: lambda bodies evaluate
    whatever they capture again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def share_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable. The cluster names the shared folder in
    ``spark.checkpoint.dir``; a folder of our own is set only in a local
    session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tabwise-llm-")
    sc.setCheckpointDir(folder)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for Python stages over whole
    texts (the default of 10,000 documents a batch is kept several times over
    by an executor and its workers). A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read
    back: later plans start from the files, a lost executor costs a re-read and
    not the lineage, and the planner knows the table's size. The files go when
    the session ends."""
    spark = df.sparkSession
    share_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tabwise-llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def hinted(df: DataFrame, max_rows: int) -> DataFrame:
    """A written table with a broadcast hint where it has at most ``max_rows``
    rows; beyond that the planner joins by shuffle (and splits skewed keys)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def double_array(values: list[float]) -> Column:
    """A constant array<double> kept as one literal (folded by the optimizer),
    not as one expression per entry."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")
