"""Space that a finished step gives back while its job is still going on."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession


def drop(*frames: DataFrame) -> None:
    """Delete the files below frames that ``stored`` returned; nothing may read them any more."""
    for frame in frames:
        spark = frame.sparkSession
        jvm = spark.sparkContext._jvm
        for file in frame.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles. Spark deletes their files once the driver's garbage collectors
    have found that no plan refers to them, which by itself may take until after the job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
