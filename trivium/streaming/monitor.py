"""Our own addition: participant statistics kept up to date while trial files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.schema import TRIALS


def stream_trials(spark: SparkSession, folder: str, schema: str = TRIALS, max_files: int = 100) -> DataFrame:
    """Trials from Parquet files as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def running_summary(trials: DataFrame) -> DataFrame:
    """(worker_id, ndat, mean_rt, checks, cacc): works on streams, in update or complete mode; the state has one row a worker."""
    check = F.col("sampleAlg") == "check"
    return trials.groupBy("worker_id").agg(
        F.count("*").alias("ndat"), F.avg("rt").alias("mean_rt"), F.count_if(check).alias("checks"),
        F.avg(F.when(check, (F.col("Answer") == F.col("Center")).cast("double"))).alias("cacc"))
