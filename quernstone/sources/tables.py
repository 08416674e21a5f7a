"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a single file and a folder of parts read alike."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise when a needed column is missing, else pass the frame on."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
