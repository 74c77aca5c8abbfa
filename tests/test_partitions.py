"""Few rows that make much work, or a growing training frame, take more than one task."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwise.operators.explain import kernel
from tabwise.operators.ml.train import PARTITION_ROWS, partitions_for
from tabwise.session import default_parallelism


def test_partitions_grow_with_the_rows(spark):
    most = default_parallelism(spark)
    assert partitions_for(0, spark) == partitions_for(PARTITION_ROWS, spark) == 1
    assert partitions_for(PARTITION_ROWS + 1, spark) == min(2, most)
    assert partitions_for(10**9, spark) == most


def test_explained_rows_lie_in_all_tasks(spark, monkeypatch):
    """Rows of a single partition are scored in the session's number of tasks."""
    seen = []

    class Halved:
        def transform(self, df):
            seen.append(df.rdd.getNumPartitions())
            return df.withColumn("prediction", F.lit(0.5))
    rows = spark.range(40).coalesce(1).select("id", array_to_vector(F.array(F.col("id") * 1.0, F.lit(2.0) * F.col("id"))).alias("features"))
    monkeypatch.setattr(kernel, "output_kind", lambda m: "prediction")
    out = kernel.lime(Halved(), rows, rows, ["a", "b"], "id", n_samples=20)
    assert seen == [default_parallelism(spark)] and out.count() == 40
