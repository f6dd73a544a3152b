"""Catalog life cycle and role schemas over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.operators.access import (
    Governor,
    grant,
    grant_conflicts,
    grant_write,
    governed_append,
    grants_frame,
    revoke,
    visible_databases,
)
from veilgrid.functions.joins import values_frame
from veilgrid.operators.checks import check_property, missing_objects
from veilgrid.sources.catalog import (
    alias_schema,
    append,
    catalog_tables,
    create_database,
    create_table,
    drop_alias,
    ensure,
    find_schemas,
    read_table as read_catalog_table,
    register_external,
)
from veilgrid.sources.tables import read_table
from veilgrid.session import scratch_root

WRITER = "loader"


def catalog_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through a typed catalog table: 'F' rows by position, 'O' rows by name as a role with a write grant
    (columns left out are NULL), read back through an alias schema, with the table's own property beside them."""
    tag = uuid.uuid4().hex[:12]
    db, alias, root = f"veil_{tag}", f"veil_{tag}_alias", scratch_root(spark, "catalog")
    orders = read_table(spark, sf_dir, "orders")
    create_database(spark, db, f"{root}/{db}")
    ensure(create_database, spark, db)  # S20: already there is success
    create_table(spark, f"{db}.orders", orders.schema, f"{root}/orders", {"table_type": "raw"})
    append(orders.filter(F.col("o_orderstatus") == "F"), f"{db}.orders")
    tables = catalog_tables(spark, [db])
    grants = grant_write(grants_frame(spark), WRITER, [(db, "absent"), (db, "orders")], tables)
    part = orders.filter(F.col("o_orderstatus") == "O").select("o_totalprice", "o_orderstatus", "o_orderkey")
    governed_append(grants, WRITER, f"{db}.orders", part)
    alias_schema(spark, alias, db)
    rows = read_catalog_table(spark, f"{alias}.orders")
    expected = values_frame(spark, [(db, ["orders", "absent"])], "database string, tables array<string>")
    found = missing_objects(expected, tables).filter("kind = 'table'").groupBy("database").pivot("status", ["Found", "Missing"]).count()
    kept = find_schemas(spark, f"veil\\_{tag}%").agg(F.count(F.lit(1)).cast("int").alias("n_schemas"))
    facts = check_property(tables, "table_type", "RAW").join(found, "database").select("property_value", "ok", "Found", "Missing")
    fact, n = facts.first(), kept.first()[0]  # one row of metadata each
    drop_alias(spark, alias)
    return rows.withColumns(
        {"property_value": F.lit(fact[0]), "property_ok": F.lit(fact[1]), "n_found": F.lit(fact[2]), "n_missing": F.lit(fact[3]), "n_schemas": F.lit(n)}
    )


def governed_role_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a role's own schema of views, after its conflicting full grant was revoked."""
    tag = uuid.uuid4().hex[:12]
    db, alias = f"veil_{tag}", f"veil_{tag}_viewer"
    create_database(spark, db, f"{scratch_root(spark, 'role-schema')}/{db}")
    customer = read_table(spark, sf_dir, "customer")
    register_external(spark, f"{db}.customer", customer.schema, f"{sf_dir.rstrip('/')}/customer.parquet")
    shown = [c for c in customer.columns if c != "c_acctbal"]
    grants = grant(grants_frame(spark), "viewer", db, None, None, ["DESCRIBE"])
    grants = grant(grant(grants, "viewer", db, "customer", shown), "helper", db, "customer")
    both = grant(grants, "viewer", db, "customer")
    n_conflicts = grant_conflicts(both).count()
    gone = values_frame(spark, [("helper", db, "customer")], "role string, database string, table string")
    gov = Governor(spark, {f"{db}.customer": customer}, revoke(grants, gone))
    gov.create_role_schema("viewer", alias)
    n_databases = visible_databases(grants, values_frame(spark, [(db,), ("other",)], "database string"), "viewer").count()
    return read_catalog_table(spark, f"{alias}.customer").withColumns(
        {"n_conflicts": F.lit(n_conflicts), "n_databases": F.lit(n_databases), "n_roles": F.lit(len(gov.roles))}
    )


QUERIES = {"catalog_orders": catalog_orders, "governed_role_schema": governed_role_schema}

ORACLES = {
    "catalog_orders": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS o_orderdate,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority,
               'raw' AS property_value, true AS property_ok, CAST(1 AS BIGINT) AS n_found, CAST(1 AS BIGINT) AS n_missing, 2 AS n_schemas
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "governed_role_schema": """
        SELECT * EXCLUDE (c_acctbal), 1 AS n_conflicts, 1 AS n_databases, 1 AS n_roles FROM customer""",
}
