"""Scans of the input tables (Parquet) and small golden fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of ``{sf_dir}/{name}.parquet``; pruning and pushdown happen at this scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
