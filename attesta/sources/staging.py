"""The shared folder, and freezing a DataFrame whose rows depend on how they were dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one below the warehouse, which on a cluster must then be
    a folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_attesta_checkpoints"
    return folder.rstrip("/")


def frozen(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder. A lost executor costs a re-read only."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
