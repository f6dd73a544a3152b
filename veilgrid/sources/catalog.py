"""Catalog DDL and scans (S1–S8, S13, S14, S20) on the session catalog.

Only catalog statements Spark itself runs; nothing is kept on the side.
Table properties use the ``gov.`` prefix because ``table_type`` is a key
Spark reserves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.functions.joins import values_frame

PROPERTY_PREFIX = "gov."


def _q(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS`` (S20: an existing one is success)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(name)}{loc}")


def _props_sql(props: Mapping[str, str] | None) -> str:
    if not props:
        return ""
    kv = ", ".join(f"'{PROPERTY_PREFIX}{k}' = '{v}'" for k, v in props.items())
    return f" TBLPROPERTIES ({kv})"


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType | str,
    path: str,
    props: Mapping[str, str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Typed table at a location, if not exists, with properties (e.g. ``table_type``)."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_q(name)} ({ddl}) USING {fmt} LOCATION '{path}'{_props_sql(props)}")


def register_external(spark: SparkSession, name: str, schema: T.StructType, path: str, fmt: str = "parquet") -> DataFrame:
    """Register files that already exist under a name, with the full column list."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.catalog.createTable(name, path=path, source=fmt, schema=schema)


def append(df: DataFrame, table: str) -> None:
    """S3: positional ``INSERT … VALUES`` — columns matched by position."""
    df.write.insertInto(table)


def by_name(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` with the target's columns, matched by name without regard to case; absent ones are NULL.

    A column that the target does not have is an error: nothing is dropped.
    """
    given = {c.lower(): c for c in df.columns}
    if len(given) < len(df.columns):
        raise ValueError(f"columns that differ in case only: {df.columns}")
    unknown = sorted(set(given) - {f.name.lower() for f in target.fields})
    if unknown:
        raise ValueError(f"columns not in the target table: {[given[c] for c in unknown]}")
    return df.select(
        *[
            (F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def append_by_name(df: DataFrame, table: str) -> None:
    """``INSERT INTO t (cols)`` — columns matched by name; absent columns become NULL, unknown ones raise."""
    by_name(df, spark_table_schema(df.sparkSession, table)).write.insertInto(table)


def spark_table_schema(spark: SparkSession, table: str) -> T.StructType:
    return spark.table(table).schema


def read_table(spark: SparkSession, ref: str) -> DataFrame:
    """Scan of ``db.table`` from the catalog."""
    return spark.table(ref)


def alias_schema(spark: SparkSession, alias: str, database: str, columns: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Another name for a database — one view per table in database ``alias``.

    ``columns`` (table → visible columns) limits what each view shows (G6).
    """
    create_database(spark, alias)
    made = []
    for t in spark.catalog.listTables(database):
        if t.tableType == "TEMPORARY":
            continue
        cols = "*" if not columns or t.name not in columns else ", ".join(f"`{c}`" for c in columns[t.name])
        spark.sql(f"CREATE OR REPLACE VIEW {_q(alias)}.`{t.name}` AS SELECT {cols} FROM {_q(database)}.`{t.name}`")
        made.append(f"{alias}.{t.name}")
    return made


def drop_alias(spark: SparkSession, alias: str) -> None:
    """``DROP SCHEMA IF EXISTS … CASCADE``."""
    spark.sql(f"DROP SCHEMA IF EXISTS {_q(alias)} CASCADE")


def catalog_tables(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """``(database, table, table_type, properties map)`` for the catalog (metadata only)."""
    rows = []
    dbs = databases if databases is not None else [d.name for d in spark.catalog.listDatabases()]
    for db in dbs:
        try:
            tables = spark.catalog.listTables(db)
        except AnalysisException:
            continue
        for t in tables:
            if t.isTemporary:
                continue
            props = {}
            try:
                for r in spark.sql(f"SHOW TBLPROPERTIES {_q(db)}.`{t.name}`").collect():
                    if r["key"].startswith(PROPERTY_PREFIX):
                        props[r["key"][len(PROPERTY_PREFIX):]] = r["value"]
            except AnalysisException:
                pass
            rows.append((db, t.name, t.tableType, props))
    schema = "database string, table string, kind string, properties map<string,string>"
    return values_frame(spark, rows, schema)


def find_schemas(spark: SparkSession, pattern: str) -> DataFrame:
    """Databases whose name matches a SQL LIKE pattern (``%``/``_``)."""
    names = [d.name for d in spark.catalog.listDatabases()]
    df = values_frame(spark, [(n,) for n in names], "database string")
    return df.filter(F.col("database").like(pattern))


def ensure(action, *args, **kwargs) -> bool:
    """Run a create action; "already exists" counts as success. Returns True if it created."""
    try:
        action(*args, **kwargs)
        return True
    except AnalysisException as e:
        if "ALREADY_EXISTS" in (e.getCondition() or "") or "already exists" in str(e).lower():
            return False
        raise
