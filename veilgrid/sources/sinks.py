"""Sinks (S11, S12, S19); the report sink (S18) is ``operators.report.write_report``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_location(workgroup_prefix: str, enforce: bool, caller_path: str | None) -> str:
    """Where query results go — an enforced workgroup prefix beats the caller's path."""
    if enforce or not caller_path:
        return workgroup_prefix
    return caller_path


def write_result(df: DataFrame, workgroup_prefix: str, query_id: str, *, enforce: bool = True, caller_path: str | None = None) -> str:
    """Write a result set under the chosen prefix, one folder per query id."""
    path = f"{result_location(workgroup_prefix, enforce, caller_path).rstrip('/')}/{query_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, base: str, database: str, table: str, ts: str, order_by: Sequence[str] = ()) -> str:
    """CSV with a header, NULL as an empty cell, under
    ``{base}/exported-data/{db}/{table}/export_{ts}.csv``.

    At scale this is a folder of part files written in parallel (a single
    object would funnel every row through one task). With ``order_by`` the
    parts are range-partitioned, so part order follows key order.
    """
    path = f"{base.rstrip('/')}/exported-data/{database}/{table}/export_{ts}.csv"
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def dataset_view(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """A typed column list over one table (a view, not a copy): ``{column: type}``.

    Types are the BI names (DATETIME, STRING, INTEGER, DECIMAL) or Spark type names.
    """
    bi = {"DATETIME": "timestamp", "STRING": "string", "INTEGER": "int", "DECIMAL": "double"}
    return df.select(*[F.col(c).cast(bi.get(t.upper(), t)).alias(c) for c, t in columns.items()])
