"""Expected-vs-actual verification reports (V1–V10), as DataFrames.

Inputs are policy/catalog metadata frames (small); the only data-sized inputs
are row counts, which come from ``count`` aggregates over pruned views.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.joins import broadcast_if_small, values_frame
from veilgrid.functions.scalars import format_cell
from veilgrid.operators.access import AccessDenied

# Fixed words of the reports.
FOUND, MISSING = "Found", "Missing"
# V2: full-access role sees a restricted column / sees none; restricted role sees none / sees one.
EXPECTED, NOTE, CORRECT, UNEXPECTED = "EXPECTED", "NOTE", "CORRECT", "UNEXPECTED"
FULL_ACCESS, RESTRICTED_ACCESS, CANNOT_SEE = "Full access", "Restricted", "Cannot see "


def check_column_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """V1: ``actual (role, database, table, columns)`` vs ``expected (role, database, table, expected_count)``.

    A role/table that is expected but has no visible columns shows actual 0.
    """
    a = actual.select("role", "database", "table", F.size("columns").alias("actual_count"))
    return (
        expected.join(broadcast_if_small(a), ["role", "database", "table"], "left")
        .withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))
        .withColumn("matches", F.col("actual_count") == F.col("expected_count"))
    )


def restricted_status(expected_access: Column, visible: Column, restricted: Column) -> Column:
    """V2: CORRECT / UNEXPECTED for restricted roles; EXPECTED / NOTE for full-access roles."""
    has = F.coalesce(F.arrays_overlap(visible, restricted), F.lit(False))
    return (
        F.when((expected_access == "FULL") & has, F.lit(EXPECTED))
        .when(expected_access == "FULL", F.lit(NOTE))
        .when(has, F.lit(UNEXPECTED))
        .otherwise(F.lit(CORRECT))
    )


def check_restricted(df: DataFrame, restricted_col: str = "restricted", expected_col: str = "expected_access") -> DataFrame:
    """V2 on a frame with ``columns`` (visible) and the restricted list of its table."""
    return df.withColumn(
        "exposed", F.array_intersect("columns", restricted_col)
    ).withColumn("status", restricted_status(F.col(expected_col), F.col("columns"), F.col(restricted_col)))


def access_matrix(expectations: DataFrame, visible: DataFrame, restricted: DataFrame) -> DataFrame:
    """V3: role × database expectations against effective columns.

    ``expectations (role, databases array, expected_access)``;
    ``visible (role, database, table, columns)``;
    ``restricted (database, table, restricted array)``.
    A role/database pair with no visible table reports ``NO_ACCESS``.
    """
    pairs = expectations.select("role", F.explode("databases").alias("database"), "expected_access")
    joined = pairs.join(visible, ["role", "database"], "left").join(
        broadcast_if_small(restricted), ["database", "table"], "left"
    )
    return (
        joined.withColumn("restricted", F.coalesce("restricted", F.array().cast("array<string>")))
        .withColumn(
            "status",
            F.when(F.col("columns").isNull(), F.lit("NO_ACCESS")).otherwise(
                restricted_status(F.col("expected_access"), F.col("columns"), F.col("restricted"))
            ),
        )
        .withColumn("n_columns", F.coalesce(F.size("columns"), F.lit(0)))
    )


def missing_objects(expected: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    """V4: expected databases and tables, Found or Missing.

    ``expected (database, tables array)``; ``catalog_tables (database, table)``.
    Tables of a missing database are not listed (the database line says it).
    """
    dbs = catalog_tables.select("database").distinct()
    exp_db = expected.select("database").distinct()
    db_rows = exp_db.join(dbs.withColumn("_f", F.lit(True)), "database", "left").select(
        F.lit("database").alias("kind"),
        F.col("database"),
        F.lit(None).cast("string").alias("table"),
        F.when(F.col("_f"), F.lit(FOUND)).otherwise(F.lit(MISSING)).alias("status"),
    )
    exp_t = expected.select("database", F.explode("tables").alias("table")).join(dbs, "database", "left_semi")
    t_rows = exp_t.join(catalog_tables.select("database", "table").withColumn("_f", F.lit(True)), ["database", "table"], "left").select(
        F.lit("table").alias("kind"),
        "database",
        "table",
        F.when(F.col("_f"), F.lit(FOUND)).otherwise(F.lit(MISSING)).alias("status"),
    )
    return db_rows.unionByName(t_rows)


def check_property(tables: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """V5: ``upper(properties[key]) = upper(value)``; absent key reads as ``default``."""
    actual = F.coalesce(F.try_element_at(F.col("properties"), F.lit(key)), F.lit(default))
    return tables.withColumn("property_value", actual).withColumn(
        "ok", F.upper(F.col("property_value")) == F.lit(value.upper())
    )


def summarize(checks: DataFrame, ok_col: str = "ok") -> DataFrame:
    """V6: ok / error / total counts and the overall verdict (PASSED when no errors)."""
    ok = F.col(ok_col)
    return checks.agg(
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("error_count"),
        F.count(F.lit(1)).alias("total_count"),
    ).withColumn("verdict", F.when(F.col("error_count") == 0, F.lit("PASSED")).otherwise(F.lit("ISSUES")))


def classify_failure(error: Column, hidden: Column | Sequence[str], restricted_role: Column) -> Column:
    """V7: a failed query of a restricted role that names a hidden column is an expected denial."""
    names = hidden if isinstance(hidden, Column) else F.array(*[F.lit(h) for h in hidden]).cast("array<string>")
    named = F.exists(names, lambda h: F.instr(F.lower(error), F.lower(h)) > 0)
    return F.when(restricted_role & F.coalesce(named, F.lit(False)), F.lit("EXPECTED_DENIAL")).otherwise(F.lit("FAILURE"))


def compare_roles(hidden_frame: DataFrame) -> DataFrame:
    """V8: column count, access level and what is hidden, added to each (role, database, table) row."""
    return hidden_frame.select(
        "*",
        F.col("n_visible").alias("column_count"),
        F.when(F.size("hidden") == 0, F.lit(FULL_ACCESS)).otherwise(F.lit(RESTRICTED_ACCESS)).alias("access_level"),
        F.when(F.size("hidden") == 0, F.lit("none"))
        .otherwise(F.concat(F.lit(CANNOT_SEE), F.array_join("hidden", ", ")))
        .alias("restrictions"),
    )


def row_count(df: DataFrame) -> DataFrame:
    """V9: ``SELECT COUNT(*)`` — reads no columns (Parquet footers only)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def visible_fraction(n_visible: Column, n_total: Column) -> Column:
    """``"x/y columns visible"``."""
    return F.format_string("%d/%d columns visible", n_visible, n_total)


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order, each cell as text (doubles with 2 decimals, NULL → 'NULL').

    The limit is the feature (a preview); ``orderBy().limit()`` plans as a
    distributed top-k (``TakeOrderedAndProject``), not a full sort.
    """
    types = dict(df.dtypes)
    top = df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(n)
    return top.select(*[format_cell(c, types[c]).alias(c) for c in df.columns])


def run_scenarios(gov, scenarios, expected_access, restricted) -> DataFrame:
    """E1 end to end: run ``(name, role, sql)`` scenarios through a ``Governor``.

    For each scenario: success → the columns returned, the row count and the
    V2 status against the role's expected access (``expected_access: role →
    FULL/RESTRICTED``) and the hidden list of the scenario's table
    (``restricted: name → columns``); failure → the error text and its V7
    class (EXPECTED_DENIAL when a restricted role named a hidden column).
    The scenario list is configuration. A query is only planned here; the row
    counts of all queries are one union of aggregates, which runs when the
    result is read.
    """
    schema = "name string, role string, sql string, success boolean, columns array<string>, error string, hidden array<string>"
    rows, counts = [], []
    for name, role, sql in scenarios:
        hidden = list(restricted.get(name, ()))
        try:
            df = gov.sql(role, sql)
        except AccessDenied as e:
            rows.append((name, role, sql, False, None, str(e), hidden))
        else:
            rows.append((name, role, sql, True, df.columns, None, hidden))
            counts.append(row_count(df).select(F.lit(name).alias("name"), "row_count"))
    spark = gov.spark
    out = values_frame(spark, rows, schema)
    # One row per scenario, by construction.
    counted = reduce(DataFrame.unionByName, counts, values_frame(spark, [], "name string, row_count long"))
    out = out.join(F.broadcast(counted), "name", "left")
    access = values_frame(spark, expected_access.items(), "role string, expected_access string")
    out = out.join(broadcast_if_small(access), "role", "left")
    # V7 with the scenario's own hidden list (the full list, not a fixed keyword list).
    failed = classify_failure(F.col("error"), F.col("hidden"), F.col("expected_access") == "RESTRICTED")
    status = F.when(F.col("success"), restricted_status(F.col("expected_access"), F.col("columns"), F.col("hidden"))).otherwise(failed)
    return out.withColumn("status", status).withColumn("n_columns", F.size("columns"))
