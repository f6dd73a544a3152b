"""Governed queries on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.joins import broadcast_if_small, values_frame
from veilgrid.functions.scalars import categorize, like
from veilgrid.operators.access import hidden_columns
from veilgrid.operators.checks import (
    access_matrix,
    check_column_counts,
    compare_roles,
    preview,
    restricted_status,
    row_count,
    run_scenarios,
    summarize,
    visible_fraction,
)
from veilgrid.plans.policy import DATABASE_OF, PUBLIC_TABLES, RESTRICTED, governor

PRICE_THRESHOLD = 50000.0


def ops_viewer_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SELECT *, CASE WHEN l_extendedprice > 50000 …`` as ops_viewer (flagship).

    ``*`` expands to the role's 9 visible columns; l_discount and l_tax are not
    in the Parquet ReadSchema at all.
    """
    gov = governor(spark, sf_dir)
    v = gov.select("ops_viewer", "ops_db.lineitem", "*")
    return v.withColumn("price_class", categorize("l_extendedprice", PRICE_THRESHOLD, "High", "Normal"))


def sales_viewer_customers_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit column list + LIKE with a ``_`` wildcard + ascending order, as sales_viewer."""
    gov = governor(spark, sf_dir)
    v = gov.select("sales_viewer", "sales_db.customer", ["c_custkey", "c_name", "c_mktsegment"])
    return v.filter(like("c_name", "Customer#00000_1%")).orderBy(F.col("c_custkey").asc_nulls_last())


def sales_viewer_segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed SQL over two role views: orders per market segment and priority."""
    gov = governor(spark, sf_dir)
    return gov.sql(
        "sales_viewer",
        """
        SELECT c.c_mktsegment, o.o_orderpriority,
               COUNT(*) AS n_orders,
               COUNT(DISTINCT o.o_custkey) AS n_customers
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment, o.o_orderpriority
        """,
    )


def part_viewer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 2 rows of part in key order, as text cells, as part_viewer."""
    gov = governor(spark, sf_dir)
    return preview(gov.select("part_viewer", "catalog_db.part", "*"), 2, ["p_partkey"])


def access_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role and granted table: visible/hidden columns, check status, rows readable.

    Column facts come from the policy (metadata); ``row_count`` is a COUNT(*)
    per table, computed once per table (not per role) and joined back.
    """
    gov = governor(spark, sf_dir)
    facts = hidden_columns(gov.effective, gov.catalog)
    counts = _row_counts(gov)
    restricted_rows = [
        (role, t, list(cols)) for role, per in RESTRICTED.items() for t, cols in per.items()
    ]
    restricted = values_frame(spark, restricted_rows, "role string, table string, restricted array<string>")
    expected = F.when(F.col("role") == "scientist", F.lit("FULL")).otherwise(F.lit("RESTRICTED"))
    # The restricted list a check looks for: the role's own list, or for a
    # full-access role every list any role has on that table.
    per_table = restricted.groupBy("table").agg(F.flatten(F.collect_list("restricted")).alias("any_restricted"))
    rep = (
        compare_roles(facts)
        .join(broadcast_if_small(restricted), ["role", "table"], "left")
        .join(broadcast_if_small(per_table), "table", "left")
        .withColumn(
            "checked",
            F.coalesce(
                F.when(F.size("restricted") > 0, F.col("restricted")),
                F.col("any_restricted"),
                F.array().cast("array<string>"),
            ),
        )
        .withColumn("expected_access", expected)
        .withColumn("status", restricted_status(F.col("expected_access"), F.col("columns"), F.col("checked")))
        .withColumn("visible_text", visible_fraction(F.col("n_visible"), F.col("n_total")))
        .join(F.broadcast(counts), ["database", "table"])  # one row per table, by construction
    )
    return rep.select(
        "role",
        "database",
        "table",
        F.col("column_count").cast("int").alias("column_count"),
        F.col("n_total").cast("int").alias("total_columns"),
        "access_level",
        "restrictions",
        "expected_access",
        "status",
        "visible_text",
        "row_count",
    )


# Fixed scenario list (ours): name, role, table the check refers to, SQL over role views.
SCENARIOS = (
    ("all_lineitem_scientist", "scientist", "lineitem", "SELECT * FROM {lineitem}"),
    ("all_lineitem_ops", "ops_viewer", "lineitem", "SELECT * FROM {lineitem}"),
    ("hidden_select_ops", "ops_viewer", "lineitem", "SELECT l_orderkey, l_discount FROM {lineitem}"),
    ("hidden_where_sales", "sales_viewer", "customer", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0"),
    ("not_granted_sales", "sales_viewer", "lineitem", "SELECT * FROM {lineitem}"),
    ("hidden_order_part", "part_viewer", "part", "SELECT p_partkey FROM {part} ORDER BY p_retailprice"),
    ("count_orders_sales", "sales_viewer", "orders", "SELECT COUNT(*) AS n FROM {orders}"),
    ("hidden_upper_case_ops", "ops_viewer", "lineitem", "SELECT L_TAX FROM {lineitem}"),
    ("base_table_ops", "ops_viewer", "lineitem", "SELECT l_discount FROM ops_db.lineitem"),
    ("cte_sales", "sales_viewer", "orders", "WITH x AS (SELECT o_custkey FROM {orders}) SELECT DISTINCT o_custkey FROM x"),
    ("cte_own_name_ops", "ops_viewer", "lineitem", "WITH raw_lines AS (SELECT * FROM raw_lines) SELECT l_discount FROM raw_lines"),
    ("cte_dotted_name_ops", "ops_viewer", "lineitem", "WITH `ops_db.lineitem` AS (SELECT 1 AS x) SELECT l_discount FROM ops_db.lineitem"),
    ("cte_inner_name_ops", "ops_viewer", "lineitem", "SELECT l_discount FROM raw_lines WHERE 1 IN (WITH raw_lines AS (SELECT 1 AS x) SELECT x FROM raw_lines)"),
)


def governed_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (role, SQL) scenario run through the role's views — columns and rows returned,
    or the denial classified (G7, G8, V2, V7)."""
    gov = governor(spark, sf_dir)
    # A scenario is checked against its table's restricted columns, whoever runs it.
    by_table: dict[str, list[str]] = {}
    for per_role in RESTRICTED.values():
        for table, cols in per_role.items():
            by_table.setdefault(table, []).extend(c for c in cols if c not in by_table.get(table, []))
    hidden = {name: by_table.get(table, []) for name, _, table, _ in SCENARIOS}
    access = {role: ("FULL" if role == "scientist" else "RESTRICTED") for _, role, _, _ in SCENARIOS}
    runs = [(name, role, sql) for name, role, _, sql in SCENARIOS]
    out = run_scenarios(gov, runs, access, hidden)
    return out.select("name", "role", "success", F.col("n_columns").cast("int").alias("n_columns"), "row_count", "status")


def _row_counts(gov) -> DataFrame:
    """(database, table, row_count) of all governed tables: one row per table."""
    parts = [
        row_count(df).select(F.lit(q.split(".")[0]).alias("database"), F.lit(q.split(".")[1]).alias("table"), "row_count")
        for q, df in gov.tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def governed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + V3: every role against every database, table by table: columns seen, status, whether their number
    is the policy's, and the rows that the role may read there."""
    gov = governor(spark, sf_dir)
    databases = sorted({t.split(".")[0] for t in gov.tables})
    wanted = [(r, databases, "FULL" if r == "scientist" else "RESTRICTED") for r in gov.roles]
    expectations = values_frame(spark, wanted, "role string, databases array<string>, expected_access string")
    hidden: dict[str, list[str]] = {}
    for per_role in RESTRICTED.values():
        for table, cols in per_role.items():
            hidden.setdefault(table, []).extend(cols)
    lists = values_frame(spark, [(DATABASE_OF[t], t, c) for t, c in hidden.items()], "database string, table string, restricted array<string>")
    matrix = access_matrix(expectations, gov.effective.select("role", "database", "table", "columns"), lists)
    numbers = []
    for name, df in gov.tables.items():
        db, table = name.split(".")
        for role in gov.roles:
            if role == "scientist" or table in PUBLIC_TABLES or table in RESTRICTED.get(role, {}):
                numbers.append((role, db, table, len(df.columns) - len(RESTRICTED.get(role, {}).get(table, ()))))
    expected = values_frame(spark, numbers, "role string, database string, table string, expected_count int")
    checked = check_column_counts(gov.effective, expected).select("role", "database", "table", "matches")
    out = matrix.join(broadcast_if_small(checked), ["role", "database", "table"], "left")
    out = out.join(F.broadcast(_row_counts(gov)), ["database", "table"], "left")  # one row per table, by construction
    return out.select("role", "database", "table", "n_columns", "status", "matches", "row_count")


def governed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: how many of the matrix's lines are as the policy says, and the verdict; lines without a table are fine."""
    matrix = governed_matrix(spark, sf_dir)
    ok = (F.col("status") != "UNEXPECTED") & F.coalesce("matches", F.lit(True)) & F.coalesce(F.col("row_count") >= 0, F.lit(True))
    out = summarize(matrix.withColumn("ok", ok))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("ok_count", "error_count", "total_count")], "verdict")


QUERIES = {
    "governed_matrix": governed_matrix,
    "governed_summary": governed_summary,
    "governed_scenarios": governed_scenarios,
    "governed_lineitem_ops_viewer": ops_viewer_lineitem,
    "governed_customer_like_sales_viewer": sales_viewer_customers_like,
    "governed_segment_orders_sales_viewer": sales_viewer_segment_orders,
    "governed_part_preview": part_viewer_preview,
    "governed_access_report": access_report,
}

# The policy (which role may read which table, and what is hidden from it) against the tables' own columns.
_COLUMNS = """
        WITH dbs(tbl, database) AS (VALUES ('customer', 'sales_db'), ('orders', 'sales_db'), ('lineitem', 'ops_db'),
            ('supplier', 'ops_db'), ('part', 'catalog_db'), ('nation', 'ref_db'), ('region', 'ref_db')),
        sizes AS (SELECT table_name AS tbl, count(*) AS n_total FROM information_schema.columns GROUP BY table_name),
        policy(role, tbl, hides) AS (
            SELECT 'scientist', tbl, CAST([] AS VARCHAR[]) FROM dbs
            UNION ALL SELECT role, tbl, CAST([] AS VARCHAR[]) FROM (VALUES ('sales_viewer'), ('ops_viewer'), ('part_viewer')) r(role),
                (VALUES ('nation'), ('region')) t(tbl)
            UNION ALL VALUES ('sales_viewer', 'customer', ['c_acctbal']), ('sales_viewer', 'orders', CAST([] AS VARCHAR[])),
                ('ops_viewer', 'lineitem', ['l_discount', 'l_tax']), ('part_viewer', 'part', ['p_retailprice'])
        ),
        granted AS (
            SELECT role, tbl, coalesce((SELECT list(column_name ORDER BY ordinal_position) FROM information_schema.columns c
                WHERE c.table_name = p.tbl AND list_contains(p.hides, c.column_name)), []) AS hidden
            FROM policy p
        )"""

_MATRIX = _COLUMNS + """,
        counts AS (
            SELECT 'customer' AS tbl, COUNT(*) AS row_count FROM customer
            UNION ALL SELECT 'orders', COUNT(*) FROM orders
            UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
            UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
            UNION ALL SELECT 'part', COUNT(*) FROM part
            UNION ALL SELECT 'nation', COUNT(*) FROM nation
            UNION ALL SELECT 'region', COUNT(*) FROM region
        ),
        any_hidden AS (SELECT tbl, flatten(list(hidden)) AS names FROM granted GROUP BY tbl),
        pairs AS (SELECT DISTINCT role, database FROM policy, dbs),
        matrix AS (
            SELECT p.role, p.database, g.tbl AS "table", CAST(coalesce(s.n_total - len(g.hidden), 0) AS INTEGER) AS n_columns,
                   CASE WHEN g.tbl IS NULL THEN 'NO_ACCESS' WHEN p.role <> 'scientist' THEN 'CORRECT'
                        WHEN len(a.names) > 0 THEN 'EXPECTED' ELSE 'NOTE' END AS status,
                   CASE WHEN g.tbl IS NOT NULL THEN true END AS matches, c.row_count
            FROM pairs p LEFT JOIN (SELECT g.*, d.database FROM granted g JOIN dbs d USING (tbl)) g ON g.role = p.role AND g.database = p.database
            LEFT JOIN sizes s ON s.tbl = g.tbl LEFT JOIN any_hidden a ON a.tbl = g.tbl LEFT JOIN counts c ON c.tbl = g.tbl
        )"""

ORACLES = {
    "governed_matrix": _MATRIX + " SELECT * FROM matrix",
    "governed_summary": _MATRIX + """
        SELECT count(*) AS ok_count, CAST(0 AS BIGINT) AS error_count, count(*) AS total_count, 'PASSED' AS verdict FROM matrix""",
    "governed_scenarios": _COLUMNS
    + """,
        runs(name, role, tbl, star, named, result_columns, n_rows) AS (VALUES
            ('all_lineitem_scientist', 'scientist', 'lineitem', true, '', 0, (SELECT COUNT(*) FROM lineitem)),
            ('all_lineitem_ops', 'ops_viewer', 'lineitem', true, '', 0, (SELECT COUNT(*) FROM lineitem)),
            ('hidden_select_ops', 'ops_viewer', 'lineitem', false, 'l_discount', 2, 0),
            ('hidden_where_sales', 'sales_viewer', 'customer', false, 'c_acctbal', 1, 0),
            ('not_granted_sales', 'sales_viewer', 'lineitem', true, '', 0, 0),
            ('hidden_order_part', 'part_viewer', 'part', false, 'p_retailprice', 1, 0),
            ('count_orders_sales', 'sales_viewer', 'orders', false, '', 1, 1),
            ('hidden_upper_case_ops', 'ops_viewer', 'lineitem', false, 'l_tax', 1, 0),
            ('base_table_ops', 'ops_viewer', '-', false, '', 1, 0),
            ('cte_own_name_ops', 'ops_viewer', '-', false, '', 1, 0),
            ('cte_dotted_name_ops', 'ops_viewer', '-', false, '', 1, 0),
            ('cte_inner_name_ops', 'ops_viewer', '-', false, '', 1, 0),
            ('cte_sales', 'sales_viewer', 'orders', false, '', 1, (SELECT COUNT(DISTINCT o_custkey) FROM orders))
        ),
        tried AS (
            SELECT r.*, g.role IS NOT NULL AND NOT list_contains(coalesce(g.hidden, []), r.named) AS success,
                   CASE WHEN star THEN coalesce(s.n_total, 0) - len(coalesce(g.hidden, [])) ELSE result_columns END AS n_columns,
                   coalesce(any_hidden, []) AS any_hidden, g.hidden AS hidden
            FROM runs r LEFT JOIN granted g ON g.role = r.role AND g.tbl = r.tbl
            LEFT JOIN sizes s ON s.tbl = r.tbl
            LEFT JOIN (SELECT tbl, flatten(list(hidden)) AS any_hidden FROM granted GROUP BY tbl) a ON a.tbl = r.tbl
        )
        SELECT name, role, success, CAST(CASE WHEN success THEN n_columns END AS INTEGER) AS n_columns,
               CAST(CASE WHEN success THEN n_rows END AS BIGINT) AS row_count,
               CASE WHEN success AND role = 'scientist' THEN CASE WHEN star AND len(any_hidden) > 0 THEN 'EXPECTED' ELSE 'NOTE' END
                    WHEN success THEN 'CORRECT'
                    WHEN role <> 'scientist' AND list_contains(coalesce(hidden, []), named) THEN 'EXPECTED_DENIAL'
                    ELSE 'FAILURE' END AS status
        FROM tried""",
    "governed_lineitem_ops_viewer": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_returnflag, l_linestatus, l_shipdate,
               CASE WHEN l_extendedprice > 50000 THEN 'High' ELSE 'Normal' END AS price_class
        FROM lineitem""",
    "governed_customer_like_sales_viewer": """
        SELECT c_custkey, c_name, c_mktsegment FROM customer
        WHERE c_name LIKE 'Customer#00000_1%' ORDER BY c_custkey""",
    "governed_segment_orders_sales_viewer": """
        SELECT c.c_mktsegment, o.o_orderpriority, COUNT(*) AS n_orders,
               COUNT(DISTINCT o.o_custkey) AS n_customers
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment, o.o_orderpriority""",
    "governed_part_preview": """
        SELECT COALESCE(CAST(p_partkey AS VARCHAR), 'NULL') AS p_partkey,
               COALESCE(p_name, 'NULL') AS p_name, COALESCE(p_brand, 'NULL') AS p_brand,
               COALESCE(p_type, 'NULL') AS p_type, COALESCE(CAST(p_size AS VARCHAR), 'NULL') AS p_size
        FROM part ORDER BY p_partkey LIMIT 2""",
    "governed_access_report": _COLUMNS
    + """,
        counts AS (
            SELECT 'customer' AS tbl, COUNT(*) AS row_count FROM customer
            UNION ALL SELECT 'orders', COUNT(*) FROM orders
            UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
            UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
            UNION ALL SELECT 'part', COUNT(*) FROM part
            UNION ALL SELECT 'nation', COUNT(*) FROM nation
            UNION ALL SELECT 'region', COUNT(*) FROM region
        ),
        any_hidden AS (SELECT tbl, flatten(list(hidden)) AS names FROM granted GROUP BY tbl)
        SELECT g.role, d.database, g.tbl AS "table", CAST(s.n_total - len(g.hidden) AS INTEGER) AS column_count,
               CAST(s.n_total AS INTEGER) AS total_columns,
               CASE WHEN len(g.hidden) = 0 THEN 'Full access' ELSE 'Restricted' END AS access_level,
               CASE WHEN len(g.hidden) = 0 THEN 'none' ELSE 'Cannot see ' || array_to_string(g.hidden, ', ') END AS restrictions,
               CASE WHEN g.role = 'scientist' THEN 'FULL' ELSE 'RESTRICTED' END AS expected_access,
               CASE WHEN g.role <> 'scientist' THEN 'CORRECT' WHEN len(a.names) > 0 THEN 'EXPECTED' ELSE 'NOTE' END AS status,
               printf('%d/%d columns visible', s.n_total - len(g.hidden), s.n_total) AS visible_text,
               c.row_count
        FROM granted g JOIN dbs d USING (tbl) JOIN sizes s USING (tbl) JOIN counts c USING (tbl) JOIN any_hidden a USING (tbl)""",
}
