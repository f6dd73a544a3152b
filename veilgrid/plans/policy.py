"""Column policy for the driver tables (the same shape as the reference's §1.1 policy).

Fixed policy values (ours, mapped onto the driver tables):
  scientist    — every column of every table
  sales_viewer — sales_db.customer without c_acctbal; sales_db.orders in full
  ops_viewer   — ops_db.lineitem without l_discount, l_tax
  part_viewer  — catalog_db.part without p_retailprice
  PUBLIC       — ref_db.nation and ref_db.region in full
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrid.operators.access import PUBLIC, Governor, grants_frame
from veilgrid.sources.tables import read_table

DATABASE_OF = {
    "customer": "sales_db",
    "orders": "sales_db",
    "lineitem": "ops_db",
    "supplier": "ops_db",
    "part": "catalog_db",
    "nation": "ref_db",
    "region": "ref_db",
}

ROLES = ("scientist", "sales_viewer", "ops_viewer", "part_viewer")

# role → {table: restricted columns}; a table listed with () is granted in full.
RESTRICTED = {
    "sales_viewer": {"customer": ("c_acctbal",), "orders": ()},
    "ops_viewer": {"lineitem": ("l_discount", "l_tax")},
    "part_viewer": {"part": ("p_retailprice",)},
}

PUBLIC_TABLES = ("nation", "region")


def governed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f"{db}.{t}": read_table(spark, sf_dir, t) for t, db in DATABASE_OF.items()}


def policy_grants(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Grant rows for the policy above; column lists are all − restricted, in table order."""
    rows = []
    for db in sorted(set(DATABASE_OF.values())):
        rows.append(("scientist", db, None, None, ["DESCRIBE"]))
    for qname in tables:
        db, t = qname.split(".", 1)
        rows.append(("scientist", db, t, None, ["SELECT"]))
    for role, per_table in RESTRICTED.items():
        dbs = set()
        for t, restricted in per_table.items():
            db = DATABASE_OF[t]
            dbs.add(db)
            if restricted:
                cols = [c for c in tables[f"{db}.{t}"].columns if c not in restricted]
                rows.append((role, db, t, cols, ["SELECT"]))
            else:
                rows.append((role, db, t, None, ["SELECT"]))
        for db in sorted(dbs):
            rows.append((role, db, None, None, ["DESCRIBE"]))
    for t in PUBLIC_TABLES:
        rows.append((PUBLIC, DATABASE_OF[t], t, None, ["SELECT"]))
    rows.append((PUBLIC, "ref_db", None, None, ["DESCRIBE"]))
    return grants_frame(spark, rows)


_GOVERNORS: dict[tuple[int, str], Governor] = {}


def governor(spark: SparkSession, sf_dir: str) -> Governor:
    """The policy is computed once per session and data folder (it is catalog metadata)."""
    key = (id(spark), sf_dir)
    gov = _GOVERNORS.get(key)
    if gov is None or gov.spark is not spark:
        tables = governed_tables(spark, sf_dir)
        gov = Governor(spark, tables, policy_grants(spark, tables), roles=list(ROLES))
        _GOVERNORS[key] = gov
    return gov
