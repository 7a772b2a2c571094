"""How many tasks a scan gets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the scan has fewer splits than that, as with one small file; larger inputs are left as they are.

    Select the columns that are needed first: they are what moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
