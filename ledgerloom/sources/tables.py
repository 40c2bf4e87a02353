"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utc(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps without zone, read as UTC instants."""
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in cols})
